"""Row numbering and running sums without a global single-partition window.

* ``ordinal_by_buckets``: numbering inside caller-given buckets that never decrease
  along the key (used for hash-valued keys, whose top bits give even buckets).
* ``global_ordinal`` / ``contiguous_rid``: distribution-free numbering from a
  range-partitioned global sort (Spark samples the key, so a dense key range or a hot
  group is split across tasks), materialised once, plus per-partition offsets.
* ``input_order``: numbering by file position, for tables read from files.
* ``places``: numbering inside groups, where one group may hold most rows.
* ``running_totals``: the same for cumulative sums (AP, tie ranks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_by_buckets(df: DataFrame, order_cols: list[str], bucket_col: str,
                       out: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """``by`` restarts the numbering per group (e.g. per class)."""
    by = list(by or [])
    counts = df.groupBy(*by, bucket_col).agg(F.count(F.lit(1)).alias("_bucket_n"))
    prefix = Window.partitionBy(*by).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, bucket_col, F.coalesce(F.sum("_bucket_n").over(prefix), F.lit(0)).alias("_bucket_off"))
    inner = Window.partitionBy(*by, bucket_col).orderBy(*order_cols)
    return (df.join(offsets, by + [bucket_col])
            .withColumn(out, F.col("_bucket_off") + F.row_number().over(inner) - 1)
            .drop("_bucket_off"))


def contiguous_rid(df: DataFrame, key: str, out: str = "rid", by: list[str] | None = None,
                   few_groups: bool = False) -> DataFrame:
    """0-based contiguous index in the order of a unique ``key`` (restarting per ``by``
    group): a distribution-free sort-based ordinal (see ``global_ordinal``)."""
    return global_ordinal(df, [F.col(key)], out, by, few_groups)


def global_ordinal(df: DataFrame, order_cols: list, out: str = "ordinal",
                   by: list[str] | None = None, few_groups: bool = False) -> DataFrame:
    """0-based position of each row in a total order (``order_cols`` must be unique).
    ``few_groups`` says that the ``by`` groups should be few (classes, folds): if they are, by their
    count, their starts are broadcast instead of shuffling the rows on a handful of keys.

    A global sort range-partitions on the full key, so even a score value held by a
    third of the rows is split across tasks by the unique tie-break column.  The sorted
    rows are checkpointed (reliable, shared folder) so the per-partition counts and the
    ids come from one materialisation; offsets come from a table with one row per
    partition."""
    from ..session import cut_lineage
    by = list(by or [])
    order_cols = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = df.orderBy(*order_cols).withColumn("_mono", F.monotonically_increasing_id())
    tagged = cut_lineage(tagged)
    pid = F.shiftright(F.col("_mono"), 33)
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    tagged = tagged.withColumn("_pid", pid).withColumn("_local", local)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pn"))
    prefix = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_pn").over(prefix), F.lit(0)).alias("_poff"))
    res = (tagged.join(F.broadcast(offsets), "_pid")  # one row per partition
           .withColumn(out, F.col("_poff") + F.col("_local"))
           .drop("_mono", "_pid", "_local", "_poff"))
    if by:  # restart per group: subtract the group's first ordinal (one row per group)
        first = res.groupBy(*by).agg(F.min(out).alias("_first"))
        res = res.join(few_rows(first, GROUPS) if few_groups else first, by).withColumn(out, F.col(out) - F.col("_first")).drop("_first")
    return res


def running_totals(df: DataFrame, order_cols: list, sum_cols: list[str], by: list[str] | None = None,
                   inclusive: bool = True, prefix: str = "cum_") -> DataFrame:
    """Running sums of ``sum_cols`` along a total order (``by`` + ``order_cols`` must be
    unique), restarting for each ``by`` group.

    Distribution-free: a range-partitioned global sort balances the work whatever the
    value distribution (a dense value range or a hot group is split across tasks by the
    unique order key).  The sorted rows are materialised once; partition totals (one row
    per partition and group) give the offsets; the running part inside a partition is a
    window partitioned by that balanced partition id."""
    from ..session import cut_lineage
    by = list(by or [])
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = df.orderBy(*[F.col(c) for c in by], *order) \
               .withColumn("_pid", F.shiftright(F.monotonically_increasing_id(), 33))
    tagged = cut_lineage(tagged, "runsum")
    tot = tagged.groupBy(*by, "_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                     for c in sum_cols])
    frame = (0 if inclusive else -1)
    within = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame)
    out = tagged.join(offs, by + ["_pid"])
    for c in sum_cols:
        out = out.withColumn(prefix + c, F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("_pid", *[f"_o_{c}" for c in sum_cols])


def places(df: DataFrame, by: list[str], order_cols: list, out: str = "place") -> DataFrame:
    """0-based place of each row in its group (null keys are one group), in the order of
    ``order_cols``; rows that tie completely follow in any order.

    The table is sorted across the cluster and written, so a large group is spread over several
    partitions; a partition's rows are numbered by themselves.  Only a partition's first group can
    have rows in earlier partitions, so the offsets are at most one row per partition."""
    from ..session import cut_lineage
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = df.withColumn("_place_tie", F.monotonically_increasing_id()).orderBy(*[F.col(c) for c in by], *order, F.col("_place_tie")) \
               .withColumn("_place_mono", F.monotonically_increasing_id()).drop("_place_tie")
    tagged = cut_lineage(tagged, "places").withColumn("_place_pid", F.shiftright("_place_mono", 33))
    runs = tagged.groupBy("_place_pid", *by).agg(F.count(F.lit(1)).alias("_place_n"))
    before = Window.partitionBy(*by).orderBy("_place_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_place_off", F.sum("_place_n").over(before)).where("_place_off > 0") \
                  .select(F.col("_place_pid").alias("_place_opid"), "_place_off", *[F.col(c).alias(f"_place_by{i}") for i, c in enumerate(by)])
    on = F.col("_place_pid") == F.col("_place_opid")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_place_by{i}"))
    within = Window.partitionBy("_place_pid", *by).orderBy("_place_mono")
    return (tagged.join(F.broadcast(offsets), on, "left")  # at most one row per partition
            .withColumn(out, F.row_number().over(within) - 1 + F.coalesce("_place_off", F.lit(0)))
            .drop("_place_pid", "_place_mono", "_place_opid", "_place_off", *[f"_place_by{i}" for i in range(len(by))]))


GROUPS = 100_000    # starts of up to so many groups are broadcast
FILES = 1_000_000   # offsets of up to so many files are broadcast (two numbers each)
BLOCK_BITS = 16     # rows of a file that are numbered together where only some rows count


def input_order(scan: DataFrame, out: str = "rid", counted: Column | None = None) -> DataFrame:
    """Rows of a Parquet scan with their 0-based number in input order: files in the order of their
    paths, rows in the order of the file.

    The number is the file's first number plus the row's place in the file, which the reader knows:
    rows are neither sorted nor shuffled, and a rerun gives the same numbers.  The scan must be one
    (``spark.read.parquet``, projected at most), so that it has ``_metadata``.  With ``counted`` only
    those rows are numbered, the others get null; rows are then shuffled once in blocks of 2**16
    rows of a file."""
    place = scan.withColumn("_file", F.xxhash64("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    path = F.col("_metadata.file_path").alias("path")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    if counted is None:
        files = scan.select(path, F.col("_metadata.row_index").alias("row")).groupBy("path").agg((F.max("row") + 1).alias("n"))
        starts = files.select(F.xxhash64("path").alias("_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
        return place.join(few_rows(starts, FILES), "_file").withColumn(out, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")
    place = place.withColumn("_block", F.shiftright("_row", BLOCK_BITS)).withColumn("_counted", F.coalesce(counted, F.lit(False)))
    blocks = scan.select(path, F.shiftright(F.col("_metadata.row_index"), BLOCK_BITS).alias("_block"), counted.alias("c")) \
                 .groupBy("path", "_block").agg(F.count(F.when(F.col("c"), 1)).alias("n"))
    files = blocks.groupBy("path").agg(F.sum("n").alias("n"))
    starts = files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of a file
    starts = blocks.join(starts, "path").select(F.xxhash64("path").alias("_file"), "_block",
                                                (F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("_start"))
    rank = F.sum(F.col("_counted").cast("long")).over(Window.partitionBy("_file", "_block").orderBy("_row"))
    return place.join(starts, ["_file", "_block"]).withColumn(out, F.when(F.col("_counted"), F.col("_start") + rank - 1)) \
                .drop("_file", "_row", "_block", "_start", "_counted")


def few_rows(df: DataFrame, most: int) -> DataFrame:
    """``df`` written, and marked for broadcast if it has no more than ``most`` rows."""
    from ..session import cut_lineage
    df = cut_lineage(df, "small")
    return F.broadcast(df) if df.count() <= most else df
