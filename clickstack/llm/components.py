"""Connected components of a link table by alternating large-star and small-star rounds.

Links never leave the cluster; every round is written to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame, a: str, b: str, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node."""
    u, v = F.col("u"), F.col("v")
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .where(u != v).distinct(), "links")
    sign = _sign(edges)
    for _ in range(rounds):
        if not sign[0]:
            break
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(u, F.min(v)).alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min(v).alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")),
                                                                F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").where(u != v).distinct(), "links")
        new = _sign(edges)
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(u.alias("node"), v.alias("component"))
    return stars.unionByName(edges.select(v.alias("node"), v.alias("component")).distinct())
