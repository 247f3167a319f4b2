"""Sharded feature cache: Parquet partitioned by ``shard`` + a manifest table.

Rows get a contiguous global index ``rid`` in input order (see operators.rowindex); shard =
floor(rid / shard_rows), so every shard but the last holds exactly ``shard_rows`` rows
and the manifest ranges tile [0, N).  Row lookups are equi-joins on the computed shard
id, never range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder


def with_shard(df: DataFrame, shard_rows: int, rid_col: str = "rid") -> DataFrame:
    return df.withColumn("shard", F.floor(F.col(rid_col) / F.lit(int(shard_rows))).cast("int"))


def manifest(df: DataFrame, rid_col: str = "rid") -> DataFrame:
    """One row per shard: rows and half-open [start, end) of global row ids."""
    return df.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(rid_col).alias("start"),
        (F.max(rid_col) + 1).alias("end"))


def write_shards(df: DataFrame, out_dir: str, shard_rows: int, rid_col: str = "rid",
                 mode: str = "overwrite", ordered: bool = False) -> DataFrame:
    """Write the block partitioned by shard (rows in rid order inside each file) and return the
    manifest read back from what was written.

    Rows are dealt by shard, so a task holds whole shards, of known size; ``ordered`` rows, as
    ``contiguous_rid`` leaves them, are written as they come."""
    return write_block(df, out_dir, shard_rows, rid_col, mode, ordered)[0]


def write_block(df: DataFrame, out_dir: str, shard_rows: int, rid_col: str = "rid", mode: str = "overwrite",
                ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """``write_shards``, which gives the manifest, and the block read back; the folders of the shards are listed
    once for both."""
    df = with_shard(df, shard_rows, rid_col)
    if not ordered:
        df = df.repartition("shard").sortWithinPartitions("shard", rid_col)
    df.write.mode(mode).partitionBy("shard").parquet(f"{out_dir}/data")
    written = df.sparkSession.read.parquet(f"{out_dir}/data")
    m = manifest(written, rid_col)
    m.write.mode(mode).parquet(f"{out_dir}/manifest")
    return df.sparkSession.read.parquet(f"{out_dir}/manifest"), written


def write_caches(train: DataFrame, test: DataFrame, spec, out_dir: str, shard_rows: int, fit_on: str = "train",
                 joined: tuple = (), rid_col: str = "rid", ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Feature blocks of train and test as two sharded caches; returns their manifests.
    ``fit_on``: the test block is filled with the medians of 'train', or 'each' with its own."""
    from ..operators import features as fe
    if fit_on not in ("train", "each"):
        raise ValueError(f"fit_on is 'train' or 'each', not {fit_on!r}")
    fitted = fe.fit(train, spec, joined)
    other = fitted if fit_on == "train" else fe.fit(test, spec, joined)
    return (write_shards(fe.transform(train, fitted, True, rid_col), f"{out_dir}/train", shard_rows, rid_col, ordered=ordered),
            write_shards(fe.transform(test, other, False, rid_col), f"{out_dir}/test", shard_rows, rid_col, ordered=ordered))


def read_block(spark: SparkSession, cache_dir: str) -> DataFrame:
    return spark.read.parquet(f"{cache_dir}/data")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory, deleted when the session ends."""
    return scratch_folder(spark, name)


def locate(index: DataFrame, man: DataFrame, shard_rows: int, i_col: str = "i") -> DataFrame:
    """(i) -> (i, shard, local): shard computed from the fixed shard size, checked
    against the manifest range by an equi-join on shard (the manifest has one row per
    shard)."""
    s = index.withColumn("shard", F.floor(F.col(i_col) / F.lit(int(shard_rows))).cast("int"))
    j = s.join(man.select("shard", "start", "end"), "shard", "left")
    ok = (F.col(i_col) >= F.col("start")) & (F.col(i_col) < F.col("end"))
    return j.select(i_col, F.when(ok, F.col("shard")).alias("shard"),
                    F.when(ok, F.col(i_col) - F.col("start")).alias("local"))


def load_labels_groups(cache_dir: str, spark: SparkSession) -> DataFrame:
    """Column-pruned read of (rid, y, groups) over all shards."""
    return spark.read.parquet(f"{cache_dir}/data").select("rid", "y", "groups")

