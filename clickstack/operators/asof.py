"""As-of join: for every row the last mark at or before it and the first mark after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def between_marks(rows: DataFrame, on: str, marks: DataFrame, at: str) -> DataFrame:
    """``rows`` with the structs ``before`` (mark with the largest ``at`` <= ``on``) and ``after`` (mark
    with the smallest ``at`` > ``on``), null where there is none or ``on`` is null.  ``at`` is unique.

    Marks and rows are sorted together across the cluster; equal rows are told apart by a number of
    their own, so a value that many rows share is spread over partitions.  The marks next to a
    partition's borders, two per partition, are carried over from its neighbours."""
    mark, row = F.struct(*[F.col(c) for c in marks.columns]), F.struct(*[F.col(c) for c in rows.columns])
    tie = F.monotonically_increasing_id()
    kind = dict(marks.select(mark.alias("m")).dtypes)["m"], dict(rows.select(row.alias("r")).dtypes)["r"]
    both = marks.select(F.col(at).alias("_x"), F.lit(0).alias("_kind"), tie.alias("_tie"), mark.alias("_mark"), F.lit(None).cast(kind[1]).alias("_row")) \
        .unionByName(rows.select(F.col(on).alias("_x"), F.lit(1).alias("_kind"), tie.alias("_tie"), F.lit(None).cast(kind[0]).alias("_mark"), row.alias("_row")))
    placed = cut_lineage(both.orderBy(F.col("_x").asc_nulls_first(), "_kind", "_tie").drop("_tie", "_kind")
                         .withColumn("_at", F.monotonically_increasing_id()), "asof").withColumn("_pid", F.shiftright("_at", 33))
    ends = placed.groupBy("_pid").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("last"),
                                      F.min_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("first"))
    past = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    future = Window.orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_pid", F.last("last", True).over(past).alias("_past"), F.last("first", True).over(future).alias("_future"))
    here = Window.partitionBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_b", F.last("_mark", True).over(here.orderBy("_at"))).withColumn("_a", F.last("_mark", True).over(here.orderBy(F.desc("_at"))))
    found = found.where("_row is not null").join(F.broadcast(ends), "_pid")  # a row per partition
    known = F.col("_x").isNotNull()
    return found.select("_row.*", F.when(known, F.coalesce("_b", "_past")).alias("before"), F.when(known, F.coalesce("_a", "_future")).alias("after"))
