"""The ``impressions`` stand-in built from the driver's ``events`` table.

One impression per event; the click history ``seq`` is the user's previous ``k``
values, newest last, as many as the widest feature reads (``max_len`` of the feature
block, 400); the features cut it to their own lengths.  Test split = ``event_id % 10 = 9``.  Scores, model
outputs and a second prediction table are plain functions of the event columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rowindex import input_order
from .tables import read_table

HISTORY = 400  # the longest max_len of any feature


def impressions(spark: SparkSession, sf_dir: str, numbered: Column | None = None) -> DataFrame:
    """``numbered``: the events that get a number ``crid`` in input order, e.g. those of a split."""
    ev = read_table(spark, sf_dir, "events")
    if numbered is not None:
        ev = input_order(ev, "crid", numbered)
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-HISTORY, -1)
    ev = ev.withColumn("h", F.collect_list("k").over(w))
    return ev.select(
        F.concat(F.lit("EV"), F.col("event_id").cast("string")).alias("ID"),
        F.col("event_id").alias("rid"),
        (F.col("event_type") == "click").cast("int").alias("clicked"),
        F.pmod(F.col("k"), F.lit(18)).alias("inventory_id"),
        F.weekday("ts").cast("int").alias("day_of_week"),
        F.hour("ts").cast("int").alias("hour"),
        F.when(F.size("h") > 0, F.array_join("h", ",")).alias("seq"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("feat_a_1"),
        F.when(F.col("event_id") % 11 != 0, (F.col("user_id") % 7).cast("string")).alias("l_feat_14"),
        F.col("user_id"), F.col("k"), F.col("value"), *(["crid"] if numbered is not None else []),
    )


def train(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """``numbered``: with ``crid``, 0 .. N-1 in input order."""
    return impressions(spark, sf_dir, F.col("event_id") % 10 != 9 if numbered else None).where(F.col("rid") % 10 != 9)


def test(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    return impressions(spark, sf_dir, F.col("event_id") % 10 == 9 if numbered else None).where(F.col("rid") % 10 == 9).drop("clicked")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per impression: probability ``p`` (many ties) and an informative logit ``z``."""
    imp = impressions(spark, sf_dir)
    return imp.select(
        "ID", "rid", "clicked", "inventory_id", "day_of_week",
        ((F.floor("value") + 1) / 600.0).alias("p"),
        ((2 * F.col("clicked") - 1) * 1.0 + (F.col("value") - 50) / 50.0).alias("z"),
    )


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four model probabilities per impression (wide table for ensembles)."""
    imp = impressions(spark, sf_dir)
    return imp.select(
        "ID", "rid", "clicked",
        ((F.floor("value") + 1) / 600.0).alias("p1"),
        ((F.col("k") + 1) / 102.0).alias("p2"),
        ((F.col("rid") % 97 + 1) / 99.0).alias("p3"),
        ((F.col("user_id") % 13 + 1) / 15.0).alias("p4"),
    )


def prediction_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two (ID, clicked) prediction tables; the second leaves out event_id % 50 = 0."""
    mo = model_outputs(spark, sf_dir)
    a = mo.select("ID", F.col("p1").alias("clicked"))
    b = mo.where(F.col("rid") % 50 != 0).select("ID", F.col("p2").alias("clicked"))
    return a, b
