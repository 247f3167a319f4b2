"""Corpus pipeline: documents to packed sequences, one operator per stage.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of documents.  Every
row is judged by itself, whether its doc_id is null, repeated or its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstack.llm import decontam, packing, simhash, suffix, toxicity
from clickstack.llm.common import row_keys
from clickstack.llm.queries import tokenizer_files
from clickstack.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_score(docs, model, "_toxicity").where(F.col("_toxicity") < 0.3).drop("_toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group (3-word shingles, 3 bits), that with the smallest doc_id."""
    rows = row_keys(docs, "_doc")
    groups = simhash.simhash_groups(rows.select(F.col("_doc").alias("doc_id"), "text"), width=3, max_bits=3)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_doc"))
    return rows.join(gone, "_doc", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that occur earlier."""
    return suffix.without_repeats(docs, width=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (5-word windows, share 0.8)."""
    rows = row_keys(docs, "_doc")
    leaks = decontam.contaminated(rows.select(F.col("_doc").alias("doc_id"), "text"),
                                  spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=5, share=0.8)
    return rows.join(leaks.select(F.col("doc_id").alias("_doc")).distinct(), "_doc", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, **tokenizer_files(), seq_len=2048, end_id=1)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffix_dedup", cut_repeats),
          ("decontamination", drop_leaks), ("packing", pack)]
ORACLE_SQL = None  # SQL cannot express the stages; tests/llm compares run() with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
