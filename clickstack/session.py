"""Spark session helpers.

Executors can be lost at any time, so lineage is cut with ``checkpoint()``
into the shared folder named by ``spark.checkpoint.dir``.  That setting is read
from the session; a scratch folder is only chosen when it is unset (local runs
and tests).
"""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "clickstack",
              shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "8g"  # local mode: the driver JVM runs every task
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, choosing a scratch one only if none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="clickstack-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, deleted when the driver's session ends."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_at_exit(spark: SparkSession, table: str) -> None:
    """Take a scratch table out of the catalog when the driver ends; its files go as all scratch files do."""
    def drop():
        if spark.getActiveSession() is not None:
            spark.sql(f"drop table if exists {table}")
    atexit.register(drop)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def may_broadcast(spark: SparkSession) -> bool:
    """Whether the session lets joins broadcast by themselves (a negative threshold forbids it)."""
    return not spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as Parquet in a fresh folder under the shared checkpoint
    directory and continue from the files.

    Same guarantee as a reliable ``checkpoint()`` (the data survives executor loss and
    the lineage is cut) but computed in ONE pass: an eager RDD checkpoint of an
    unpersisted plan runs the plan twice (count, then write)."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
