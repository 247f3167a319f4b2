"""Operators for preparing training text at scale (documents, pages, benchmark tables).

Each module holds one operator as ``DataFrame -> DataFrame`` functions; ``queries.py``
registers one query per operator.  Nothing else in the library imports this package."""
