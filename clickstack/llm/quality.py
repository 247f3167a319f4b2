"""Quality by an interpolated modified Kneser-Ney n-gram model over characters.

Trusted documents are counted into n-grams (a task adds up its own before the shuffle);
lower orders take continuation counts; discounts come from the counts of counts.  Joins
that are sharded by n-gram give the model's probability of every distinct n-gram of the
corpus, level by level, and the perplexity of a document is the sum over its own n-grams.
The most frequent n-grams, at most ``table_rows``, are looked up in a sorted broadcast table; rows
(document, n-gram, count) of the others are joined with the sharded table.  Code points from
NEAR on (Chinese, Japanese, Korean, emoji ...) are two symbols, a high and a low part, so the model
tells all of them apart.

A document is kept if its perplexity does not exceed a high quantile of trusted documents of
its language.  The quantiles come from trusted documents that the model has not counted (one
in ``hold_out``).

Defined cases: null and empty texts have no perplexity and are not kept; a document whose
language has no trusted document is held against the quantiles of all; without trusted
documents nothing can be judged and every text that is not empty is kept; every row is
scored, whatever rows repeat its id or text; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, code_points, text_slices

BITS = 12  # per symbol
START = 0
NEAR = 2976  # code points below are a symbol of their own; 2976 + (0x10FFFF >> 10) < 2**12


def gram_codes(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, packed n-gram) for each symbol, texts begun by ``order - 1`` start symbols.
    White space is one symbol."""
    cps, at = code_points(data, offs)
    sym = cps.astype(np.uint64)
    sym[(cps >= 9) & (cps <= 13)] = 32
    far = cps >= NEAR
    if far.any():
        after = np.concatenate([[0], np.cumsum(1 + far)])  # symbols before each code point
        sym = np.repeat(sym, 1 + far)
        low, high = after[1:][far] - 1, after[:-1][far]
        sym[high] = np.uint64(NEAR) + (sym[high] >> np.uint64(10))
        sym[low] &= np.uint64(1023)
        at = after[at]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    place = np.arange(len(sym)) - at[doc]
    code = np.zeros(len(sym), np.uint64)
    for back in range(order - 1, -1, -1):
        s = np.full(len(sym), START, np.uint64)
        if back < len(sym):
            s[back:] = sym[:len(sym) - back]
        s[place < back] = START
        code = code << np.uint64(BITS) | s
    return doc, code.view(np.int64)


def _mask(k: int) -> int:
    return (1 << (BITS * k)) - 1


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(code, n) over all texts."""
    def run(batches):
        codes, counts, held = [], [], 0
        def flush():
            c = np.concatenate(codes)
            o = np.argsort(c, kind="stable")
            c, n = c[o], np.concatenate(counts)[o]
            lead = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            return c[lead], np.add.reduceat(n, lead)
        for _, data, offs in text_slices(batches, [], "text", 2 << 20):
            _, code = gram_codes(data, offs, order)
            c, n = np.unique(code, return_counts=True)
            codes.append(c)
            counts.append(n)
            held += len(c)
            if held > 4_000_000:
                c, n = flush()
                codes, counts, held = [c], [n], 0
                if len(c) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64))], names=["code", "n"])
                    codes, counts = [], []
        if codes:
            c, n = flush()
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64))], names=["code", "n"])

    return arrow_map(texts.select("text"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (r or 0 for r in counts.agg(*[F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]).first())
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def gram_probabilities(trusted: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """(code, logp) of every n-gram in ``wanted`` (code); ``trusted`` (code, n) are the counts."""
    code = F.col("code")
    levels = [cut_lineage(trusted, "gram-counts")]
    for k in range(order - 1, 0, -1):  # continuation counts: kinds of n-grams that end so
        levels.append(cut_lineage(levels[-1].groupBy(code.bitwiseAND(F.lit(_mask(k))).alias("code"))
                                  .agg(F.count(F.lit(1)).alias("n")), "gram-counts"))
    levels.reverse()
    wants = [wanted]
    for k in range(order - 1, 0, -1):
        wants.append(wants[-1].select(code.bitwiseAND(F.lit(_mask(k))).alias("code")).distinct())
    wants.reverse()
    symbols = levels[0].count() + 1
    p = None
    for k, (counts, want) in enumerate(zip(levels, wants), 1):
        d1, d2, d3 = discounts(counts)
        n = F.col("n")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        before = F.shiftright(code, BITS)
        space = counts.groupBy(before.alias("h")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cuts"))
        own = (counts.select("code", "n", before.alias("h")).join(space, "h")
               .select("code", (F.greatest(n - cut, F.lit(0.0)) / F.col("total")).alias("alpha")))
        left = space.select("h", (F.col("cuts") / F.col("total")).alias("gamma"))
        rows = want.withColumn("h", before).join(own, "code", "left").join(left, "h", "left")
        if p is None:
            lower = F.lit(1.0 / symbols)
        else:
            rows = rows.withColumn("low", code.bitwiseAND(F.lit(_mask(k - 1)))).join(p, "low")
            lower = F.col("p_low")
        prob = F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * lower
        p = cut_lineage(rows.select(code.alias("low"), prob.alias("p_low")), "gram-probabilities")
    return p.select(F.col("low").alias("code"), F.log("p_low").alias("logp"))


def common_grams(table: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Rows of ``table`` whose n-grams occur so often in ``counts`` that there are at most ``most``."""
    band = F.floor(F.log2("n") * 4).cast("int")
    bands = counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("kinds")).orderBy(F.desc("band")).collect()  # some 200 rows
    least, held = None, 0
    for b in bands:
        held += b["kinds"]
        if held > most:
            break
        least = b["band"]
    often = counts.where(band >= least) if least is not None else counts.where("false")
    return table.join(often.select("code"), "code", "left_semi")


def log_likelihoods(docs: DataFrame, table: DataFrame, common: DataFrame, order: int) -> DataFrame:
    """(doc_id, lang, ll, n) of each row of ``docs`` (doc_id, lang, text).  n-grams of ``common`` are looked up
    in a sorted array in the tasks, the others are joined with the sharded ``table``."""
    got = common.toArrow()
    codes, logp = got.column("code").to_numpy(), got.column("logp").to_numpy()
    o = np.argsort(codes)
    shared = docs.sparkSession.sparkContext.broadcast((codes[o], logp[o]))
    names = ["row", "doc_id", "lang", "code", "ll", "n"]

    def look(batches):
        codes, logp = shared.value
        for rows, data, offs in text_slices(batches, ["row", "doc_id", "lang"], "text", 2 << 20):
            doc, code = gram_codes(data, offs, order)
            u, which = np.unique(code, return_inverse=True)
            at = np.minimum(np.searchsorted(codes, u), max(0, len(codes) - 1))
            known = codes[at] == u if len(codes) else np.zeros(len(u), bool)
            value = np.zeros(len(u))
            value[known] = logp[at[known]]
            texts = len(offs) - 1
            ll, n = np.bincount(doc, value[which], minlength=texts), np.bincount(doc, minlength=texts)
            none = pa.nulls(texts, pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns, none, pa.array(ll), pa.array(n.astype(np.int64))], names=names)
            rare = ~known[which]
            if rare.any():
                pair, times = np.unique(doc[rare] * len(u) + which[rare], return_counts=True)
                of = pa.array(pair // len(u))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(of), pa.nulls(len(pair), pa.int64()), pa.nulls(len(pair), pa.string()), pa.array(u[pair % len(u)]),
                     pa.nulls(len(pair), pa.float64()), pa.array(times.astype(np.int64))], names=names)

    parts = cut_lineage(arrow_map(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text"), look,
                                  "row long, doc_id long, lang string, code long, ll double, n long"), "likelihood-parts")
    rest = (parts.where("code is not null").select("row", "code", "n").join(table, "code")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("more")))
    return parts.where("code is null").join(rest, "row", "left").select(
        "doc_id", "lang", (F.col("ll") + F.coalesce("more", F.lit(0.0))).alias("ll"), "n")


def judged(docs: DataFrame, labels: DataFrame, order: int = 5, quantile: float = 0.995, hold_out: int = 10,
           table_rows: int = 1_000_000, broadcast_ids: int = 5_000_000) -> DataFrame:
    """(doc_id, perplexity, threshold, keep) of every row.  The ``table_rows`` most frequent n-grams at most
    are broadcast."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"))
    good = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
            .withColumn("fresh", F.crc32(F.col("doc_id").cast("string").cast("binary")) % hold_out == 0))
    good = F.broadcast(good) if good.count() <= broadcast_ids else good
    trusted = gram_counts(rows.join(good, "doc_id").where(~F.col("fresh")), order)
    every = cut_lineage(gram_counts(rows, order), "gram-kinds")
    table = gram_probabilities(trusted, every.select("code"), order)
    ll = cut_lineage(log_likelihoods(rows, table, common_grams(table, every, table_rows), order)
                     .withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("ll") / F.col("n")))), "perplexities")
    known = ll.join(good.where("fresh"), "doc_id").where("perplexity is not null")
    q = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by_lang = known.groupBy(F.coalesce("lang", F.lit("")).alias("of")).agg(q.alias("q"))  # a row per language
    whole = known.agg(q.alias("q_all"))
    told = (ll.withColumn("of", F.coalesce("lang", F.lit(""))).join(F.broadcast(by_lang), "of", "left")
            .join(F.broadcast(whole), F.lit(True), "left").withColumn("q", F.coalesce("q", "q_all")))
    fits = F.col("q").isNull() | (F.col("perplexity") <= F.col("q"))
    return told.select("doc_id", "perplexity", F.col("q").alias("threshold"),
                       F.coalesce(F.col("perplexity").isNotNull() & fits, F.lit(False)).alias("keep"))
