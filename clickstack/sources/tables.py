"""Parquet / CSV sources and sinks."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def union_key_sources(spark: SparkSession, paths: list[str], col: str) -> DataFrame:
    """One column from several sources as strings; sources without it are skipped with a
    warning, no usable source is an error."""
    frames = []
    for p in paths:
        df = spark.read.parquet(p)
        if col in df.columns:
            frames.append(df)
        else:
            log.warning("%s: column %r missing, skipped", p, col)
    return union_frames(frames, col)


def union_frames(frames: list[DataFrame], col: str) -> DataFrame:
    """Same as ``union_key_sources`` for frames already loaded."""
    parts = [f.select(F.col(col).cast("string").alias(col)) for f in frames if col in f.columns]
    if not parts:
        raise ValueError(f"no source holds column {col!r}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction CSV with header; ID forced to string, extra columns ignored."""
    return (spark.read.option("header", True).csv(path)
            .select(F.col("ID").cast("string").alias("ID"),
                    F.col("clicked").cast("double").alias("clicked")))


def submission_frame(df: DataFrame, id_col: str = "ID", p_col: str = "clicked") -> DataFrame:
    """Rows as written to a submission CSV: ID string and the probability printed '%.8f'."""
    return df.select(F.col(id_col).cast("string").alias("ID"),
                     F.format_string("%.8f", F.col(p_col).cast("double")).alias("clicked"))


def write_submission(df: DataFrame, path: str, id_col: str = "ID", p_col: str = "clicked",
                     mode: str = "overwrite") -> None:
    submission_frame(df, id_col, p_col).write.mode(mode).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics log: each run appends its rows (fold, split, AP, WLL, score, ...)."""
    metrics.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
