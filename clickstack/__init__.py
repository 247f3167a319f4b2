"""clickstack: click-through-rate feature, fold, metric and calibration jobs on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a small fit that
returns a one-row / knot table) written with the DataFrame API, so Catalyst
plans, prunes and pushes down the work.  See README.md for the layout.
"""

__version__ = "0.1.0"
