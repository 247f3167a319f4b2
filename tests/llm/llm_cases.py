"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 97} the {i % 13}" for i in range(30_000))
DOCS = [
    (1, "The cat and the dog went to the old market, and the rain fell on them all day long.", "en", "a"),
    (2, "The cat and the dog went to the old market, and the rain fell on them all day long.", "en", "a"),
    (3, "the CAT and the dog went to the old market, and the rain fell on them all day long.", "en", "b"),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, "   \n\t ", "de", None),
    (7, "Ünïcödé ßtraße 漢字 кириллица and 🙂 emoji", "de", "c"),
    (8, LONG, "en", "a"),
    (9, "x" * 5000, "en", "a"),
    (10, "12 345 6.7 !!!", None, "a"),
    (11, "You are an idiot and they said you are a moron, stupid trash.", "en", "a"),
    (11, "You are an idiot and they said you are a moron, stupid trash.", "en", "a"),
    (12, "Hello\r\n\r\nWARC/1.1 world", "en", "a"),
    (-5, "one", "en", "a"),
    (None, "A row without an id, but with a text of its own.", "en", "a"),
]
# names that the operators use themselves
CLASH = ["start", "length", "fp", "low", "left", "right", "spans", "score", "bucket", "sigs", "hash", "id", "n", "doc", "row"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def docs(spark):
    df = spark.createDataFrame(DOCS, SCHEMA).withColumn("n_chars", F.char_length("text").cast("long"))
    return df.withColumns({c: F.lit(c) for c in CLASH})


def empty_docs(spark):
    return docs(spark).where("false")


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def texts(spark, name="documents", key="doc_id"):
    return [(r[0], r[1]) for r in table(spark, name).select(key, "text").collect()]
