"""Joins of rows to groups, where a few groups may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_sized(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, parts: int = 1000) -> DataFrame:
    """Null-safe left join of ``rows`` to ``groups``, which has one row per key and in ``size`` how many
    of ``rows`` have it.  Groups that hold a ``parts``-th of all sized rows or more, so at most
    ``parts`` of them, are broadcast; only rows of smaller groups are shuffled.  Both tables are read
    more than once and should be written ones."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) * parts >= F.lit(total)
    side = groups.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    few = side.where(heavy)
    big = rows.join(F.broadcast(few), on, "inner").drop(*names)
    rest = rows.join(F.broadcast(few.select(*names)), on, "left_anti").join(side.where(~heavy), on, "left").drop(*names)
    return big.unionByName(rest)
