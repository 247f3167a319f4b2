"""Exact duplicates by progressive refinement: length, then hash of the head, then hash of everything.

One scan takes the length and the hash of the first characters of every normalised text and counts
the (length, head) groups.  Only texts of groups with company go on: their whole content is hashed
in a second scan, and groups are formed by (length, head, SHA-256).  The surviving groups reach the
second scan as a bit table of fixed size, a broadcast that does not grow with the data; a foreign
group that shares a bit costs a hash of its texts and changes no result.

Defined cases: null text counts as empty, all empty texts are equal.  A null id sorts after every
id; rows that repeat an id and a text are rows of one group, exactly one of them is kept.  An empty
table gives no rows.  Other columns, whatever their names, take no part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import join_sized

BLANKS = " \t\n\x0b\f\r"  # fixed values: the characters deleted before texts are compared
HEAD = 64                 # characters of the head
BITS = 24                 # the bit table has 2**BITS bits


def normalised(text: Column) -> Column:
    return reduce(lambda c, b: F.replace(c, F.lit(b), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def _bit(n_bytes: Column, head: Column) -> Column:
    return F.pmod(F.xxhash64(n_bytes, head), F.lit(1 << BITS))


def _crowded(texts: DataFrame) -> DataFrame:
    """(word, mask) of the bit table that holds every (length, head) group of two texts or more."""
    sizes = cut_lineage(texts.select(F.octet_length("norm").alias("n_bytes"), F.xxhash64(F.left("norm", F.lit(HEAD))).alias("head"))
                        .groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("n")), "sizes")
    lengths = sizes.groupBy("n_bytes").agg(F.sum("n").alias("_n")).where("_n > 1").select("n_bytes")
    groups = sizes.join(lengths, "n_bytes", "left_semi").where("n > 1")
    bit = _bit(F.col("n_bytes"), F.col("head"))
    return cut_lineage(groups.select(bit.alias("bit"))
                       .selectExpr("shiftright(bit, 6) word", "shiftleft(1L, cast(bit & 63 as int)) m")
                       .groupBy("word").agg(F.bit_or("m").alias("mask")), "crowded")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple = (), digests: bool = False) -> DataFrame:
    """One row per input row: ``key``, ``keep_id`` (key of the row that stays), ``group_size``, ``kept``,
    ``digest`` (SHA-256 of the normalised text, hexadecimal) and a struct ``carried`` of the columns
    ``carry``.  Of equal texts the one with the most characters before normalisation stays, then the
    one with the smallest key.

    ``digest`` is null for a text that was told apart by length and head, unless ``digests`` asks for
    the hash of every text."""
    texts = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("norm"),
                        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"),
                        F.struct(F.lit(None).alias("_"), *carry).alias("carried"))
    words = _crowded(texts)  # at most 2**BITS / 64 rows
    sized = texts.select("*", F.octet_length("norm").alias("n_bytes"), F.xxhash64(F.left("norm", F.lit(HEAD))).alias("head"))
    sized = sized.withColumn("bit", _bit(F.col("n_bytes"), F.col("head"))).withColumn("word", F.shiftright("bit", 6))
    seen = sized.join(F.broadcast(words), "word", "left").withColumn(
        "company", F.expr("coalesce(shiftright(mask, cast(bit & 63 as int)) & 1 = 1, false)"))
    full = F.unhex(F.sha2("norm", 256))
    rows = cut_lineage(seen.select("id", "n_points", "n_bytes", "head", "company", "carried",
                                   (full if digests else F.when(F.col("company"), full)).alias("full"),
                                   F.monotonically_increasing_id().alias("row")), "refined")
    best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = cut_lineage(rows.where("company").groupBy("n_bytes", "head", "full")
                         .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1"), "groups")
    joined = join_sized(rows.where("company"), groups, ["n_bytes", "head", "full"], "group_size")
    alone = rows.where("not company").withColumn("group_size", F.lit(None).cast("long")).withColumn("best", F.lit(None).cast(groups.schema["best"].dataType))
    out = joined.unionByName(alone)
    own = F.col("group_size").isNull()
    return out.select(F.col("id").alias(key), F.when(own, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      (own | (F.col("best.row") == F.col("row"))).alias("kept"),
                      F.lower(F.hex("full")).alias("digest"), "carried")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    got = classes(docs, key, text, carry=tuple(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    return got.where("kept").select(*[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(docs.columns)])
