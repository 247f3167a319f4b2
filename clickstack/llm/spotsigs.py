"""Document fingerprints by spot signatures, in DataFrame functions only.

A spot signature is a common word (an anchor) with the chain of the next ``chain`` content
words after it; common words within the chain are passed over.  A text's fingerprint is the
sorted set of its signatures' 32-bit hashes.  Two fingerprints are alike by the Jaccard
measure of their sets.

``near_classes`` finds all texts that are alike to ``threshold`` or more: copies are merged
first; two sets can only be that alike if their sizes are within that ratio, so sets are
partitioned by length and meet in the partitions their partners can be in; of each set only
the rarest signatures that a partner must share are joined; the size ratio prunes pairs
before the sets are compared.

Defined cases: a null text is empty; a text without a signature has the single signature of
all its words, so that only equal texts are alike in this way; rows that repeat a doc_id with
one text are one document in the order; null doc_ids sort first; extra columns are ignored;
an empty table gives an empty result."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components

# Common words of English, German, French and Spanish.
ANCHORS = sorted(set((
    "the of and to a in is it that was for on are as with his they at be this from or had by not but what all were we when "
    "your can an which their if will there how would been have has he she you do "
    "der die das und ist von mit den dem des ein eine einer einen nicht sich auf für im zu auch es an als bei nach wie aus war "
    "le la les un une des du de et est que qui dans pour par sur avec pas plus ce cette il elle au aux ou en son sa ses "
    "el los las uno una unos y que en por con para su se del al lo como más pero sus o este sí porque esta entre cuando muy").split()))
NO_ID = -(1 << 63)


def signatures(text: Column, chain: int = 2) -> Column:
    """Sorted distinct signature hashes (array<int>) of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _signatures(words, chain)


def _short(h: Column) -> Column:
    return F.shiftright(h, 32).cast("int")


def _signatures(words: Column, chain: int) -> Column:
    # the helper lambda binds its value once, so that long expressions are not repeated
    def let(value: Column, body):
        return F.transform(F.array(value), body)[0]

    def of(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(~w.isin(ANCHORS), i)), lambda i: i.isNotNull())
        return let(places, lambda p: found(words, p))

    def found(words: Column, p: Column) -> Column:
        """``p``: places of the content words.  The anchors just before a content word share its chain."""
        def at(j: Column) -> Column:
            here = F.get(p, j)
            before = F.coalesce(F.get(p, j - 1), F.lit(-1))
            follow = [F.coalesce(F.get(words, F.get(p, j + k)), F.lit("")) for k in range(1, chain)]
            first = F.xxhash64(F.get(words, here), *follow)
            return F.when(here - before > 1, F.transform(
                F.slice(words, before + 2, here - before - 1), lambda a: _short(F.xxhash64(a, first))))

        n = F.size(p)
        spots = F.when(n > 0, F.flatten(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at),
                                                 lambda x: x.isNotNull())))
        alone = F.array(_short(F.xxhash64(F.array_join(words, " "))))
        return let(F.coalesce(spots, F.array().cast("array<int>")),
                   lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).otherwise(alone))

    return let(words, of)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), " ")


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard measure of two signature sets; 0 without comparing them where their sizes alone
    keep it below ``least``."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = F.when(high == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))
    return F.when(low < F.lit(least) * high, F.lit(0.0)).otherwise(exact)


def beside_next(docs: DataFrame, chain: int = 2, per_bucket: int = 1000) -> DataFrame:
    """Each document with its edited text and the next document in descending doc_id (after the
    last: the first): doc_id, n_chars, edited, sigs, edited_sigs, next_sigs.

    Documents are dealt to buckets of neighbouring doc_ids, cut at approximate quantiles, and
    every bucket also gets the first document of the one below, so the next document is found
    inside a bucket and the texts are shuffled once."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = rows.select("doc")
    count = ids.count()
    cuts = max(1, min(100_000, count // per_bucket))
    inner = ids.select(F.col("doc").cast("double").alias("x")).approxQuantile(
        "x", [i / cuts for i in range(1, cuts)], 0.2 / cuts) if cuts > 1 else []
    splits = [-math.inf, *sorted(set(inner)), math.inf]
    cutter = Bucketizer(splits=splits if len(splits) > 2 else [-math.inf, 0.0, math.inf], inputCol="x", outputCol="b")

    def dealt(df: DataFrame) -> DataFrame:
        return cutter.transform(df.withColumn("x", F.col("doc").cast("double"))).withColumn("bucket", F.col("b").cast("int")).drop("x", "b")

    # one row per bucket: its largest doc_id is the next of the smallest in the bucket above
    tops = dealt(ids).groupBy("bucket").agg(F.max("doc").alias("doc")).orderBy("bucket").collect()
    halo = [(hi.doc, lo.bucket, False) for hi, lo in zip(tops, tops[1:])]
    if tops:
        halo.append((tops[-1].doc, tops[0].bucket, True))  # round from the last to the first
    guests = spark.createDataFrame(halo, "doc long, bucket int, round boolean")
    keyed = dealt(rows).withColumn("h", F.xxhash64("text"))
    # of rows that repeat the largest doc_id the one that stands first in the order
    extra = (keyed.drop("bucket").join(F.broadcast(guests), "doc")  # a row per bucket
             .select("doc", "doc_id", "text", "h", "bucket", F.lit(True).alias("guest"), "round"))
    home = keyed.select("doc", "doc_id", "text", "h", "bucket", F.lit(False).alias("guest"), F.lit(False).alias("round"))
    # last place: guests come after the bucket's own rows, as they are smaller or the way round
    spread = home.unionByName(extra).repartition("bucket").withColumn("sigs", signatures(F.col("text"), chain)) \
        .withColumn("doc_no", F.dense_rank().over(Window.partitionBy("bucket").orderBy("round", F.desc("doc"), F.desc("h"))))
    w = Window.partitionBy("bucket").orderBy("doc_no").rangeBetween(1, 1)
    nxt = spread.withColumn("next_text", F.first("text").over(w)).withColumn("next_sigs", F.first("sigs").over(w)).where(~F.col("guest"))
    text, other = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.char_length(text)
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - k), F.substring(other, F.lit(1), k))
    return (nxt.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
            .select("doc_id", "n_chars", "edited", "sigs", signatures(F.col("edited"), chain).alias("edited_sigs"), "next_sigs"))


def near_classes(docs: DataFrame, threshold: float = 0.8, chain: int = 2) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id reachable over likeness of ``threshold``
    or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text"), chain).alias("sigs"))
    rows = cut_lineage(rows.withColumn("key", F.xxhash64("sigs", F.lit(1))), "signature-sets")
    sets = cut_lineage(rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.first("sigs").alias("sigs"))
                       .withColumn("n", F.size("sigs")), "distinct-sets")
    ratio = math.log(1 / threshold)
    sets = sets.withColumn("part", F.floor(F.log(F.col("n")) / ratio + 1e-9).cast("int"))
    items = sets.select("key", "n", "part", F.explode("sigs").alias("s"))
    often = items.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    by_set = Window.partitionBy("key").orderBy("df", "s")
    prefix = (items.join(often, "s").withColumn("r", F.row_number().over(by_set))
              .where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("key", "n", "part", "s"))
    a = prefix.select(F.col("key").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "s")
    b = prefix.select(F.col("key").alias("b"), F.col("n").alias("nb"), "part", "s")
    near = (a.join(b, ["part", "s"]).where((F.col("na") <= F.col("nb")) & (F.col("a") != F.col("b"))
                                           & (F.col("na") >= F.col("nb") * threshold - 1e-9))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    of = sets.select("key", "sigs")
    links = (near.join(of.select(F.col("key").alias("a"), F.col("sigs").alias("sa")), "a")
             .join(of.select(F.col("key").alias("b"), F.col("sigs").alias("sb")), "b")
             .where(pruned_jaccard(F.col("sa"), F.col("sb"), threshold) >= threshold - 1e-12).select("a", "b"))
    comp = components(links, "a", "b").withColumnRenamed("node", "key")
    joined = sets.select("key", "low").join(comp, "key", "left").withColumn("component", F.coalesce("component", "key"))
    lows = joined.groupBy("component").agg(F.min("low").alias("class_id"))
    return rows.select("doc_id", "key").join(joined.join(lows, "component").select("key", "class_id"), "key").select("doc_id", "class_id")
