"""Reproducible draws without driver loops: every random choice is a hash of
(seed, epoch, batch, slot, ...) turned into an index, and rows are fetched by an
equi-join on (class, index)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEP, hash_fraction, md5_u60
from ..functions.prob import softplus
from .rowindex import GROUPS, contiguous_rid, few_rows, global_ordinal


def draw(parts: list, modulus) -> F.Column:
    """md5-based uniform index in [0, modulus)."""
    key = F.concat_ws(SEP, *[(F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string"))
                             for p in parts])
    return F.pmod(md5_u60(key), modulus)


def permuted(x: F.Column, n: F.Column, parts: list, rounds: int = 4, walk: int = 64) -> F.Column:
    """Place of ``x`` in a keyed permutation of [0, n): a Feistel network on a grid of about n cells,
    walked on until it lands below n.  Fewer than sqrt(n) cells lie beyond n, so a walk ends after
    a step or two; it can take no more than their number, and for more than ``walk`` of them a walk
    that long has a probability below n ** (-walk / 2)."""
    wide = F.ceil(F.sqrt(n)).cast("long")
    high = F.floor((n + wide - 1) / wide).cast("long")

    def step(v):
        left, right = F.floor(v / wide).cast("long"), v % wide
        for r in range(rounds):
            if r % 2 == 0:
                left = (left + draw([*parts, r, right], F.lit(1 << 60))) % high
            else:
                right = (right + draw([*parts, r, left], F.lit(1 << 60))) % wide
        return left * wide + right

    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), step(x), lambda v, _: F.when(v < n, v).otherwise(step(v)))


def class_index(df: DataFrame, label: str, rid: str = "rid", by: list[str] | None = None,
                out: str = "idx") -> DataFrame:
    """Contiguous 0-based index of each row inside its class (and ``by`` groups), in
    rid order; distribution-free (sort-based), no single-partition window."""
    return contiguous_rid(df, rid, out, by=list(by or []) + [label], few_groups=True)


def balanced_batches(df: DataFrame, label: str, batch_size: int, pos_fraction: float = 0.5,
                     num_batches: int | None = None, replacement: bool = True, seed: int = 777,
                     epoch: int = 0, drop_last: bool = True, rid: str = "rid") -> DataFrame:
    """(batch, slot, rid): each batch has round(bs*frac) positives, the rest negatives."""
    per_class = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect() if r[0] in (0, 1)}  # two rows
    if len(per_class) < 2:
        raise ValueError("balanced batches need both classes")
    size = {1: int(round(batch_size * pos_fraction))}
    size[0] = batch_size - size[1]
    if not replacement and any(size[c] > per_class[c] for c in size):
        raise ValueError(f"a batch needs {size[1]} positives and {size[0]} negatives, there are {per_class[1]} and {per_class[0]}")
    if num_batches is None:
        full, rest = divmod(sum(per_class.values()), batch_size)
        num_batches = full + (rest > 0 and not drop_last)
    slots = df.sparkSession.range(max(1, int(num_batches)) * batch_size).select(
        F.expr(f"id div {int(batch_size)}").alias("batch"), (F.col("id") % batch_size).alias("slot"))
    positive = F.col("slot") < size[1]
    cls, pool = positive.cast("int"), F.when(positive, F.lit(per_class[1])).otherwise(F.lit(per_class[0])).cast("long")
    if replacement:
        pick = draw([seed, epoch, F.col("batch"), F.col("slot")], pool)
    else:  # a permutation of its own for every batch and class
        j = F.when(positive, F.col("slot")).otherwise(F.col("slot") - size[1])
        pick = permuted(j, pool, [seed, epoch, F.col("batch"), cls])
    slots = slots.select("batch", "slot", cls.alias("_cls"), pick.alias("idx"))
    indexed = class_index(df.select(rid, F.col(label).cast("int").alias("_cls")), "_cls", rid)
    return slots.join(indexed, ["_cls", "idx"]).select("batch", "slot", rid)


def hash_sample(df: DataFrame, key_cols: list[str], fraction: float, seed: int = 2025) -> DataFrame:
    """Reproducible Bernoulli sample: keep rows whose hash draw is below ``fraction``."""
    return df.where(hash_fraction(key_cols, seed) < F.lit(float(fraction)))


def hard_negatives(df: DataFrame, label: str, z: str, frac: float, by: list[str] | None = None,
                   rid: str = "rid") -> DataFrame:
    """Per group, the top ``max(1, int(frac * n_neg))`` negatives by logit (ties by rid).
    A global sort on (group, -z, rid) numbers rows without a per-group single task."""
    by = list(by or [])
    if not by:  # one group: a constant key keeps the plan an equi-join
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    neg = df.where(F.col(label) != 1)
    ordd = global_ordinal(neg, [*[F.col(c) for c in by], F.desc(z), F.col(rid)], "_o")
    first = ordd.groupBy(*by).agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_nneg"))
    k = F.greatest(F.lit(1), F.floor(F.col("_nneg") * F.lit(float(frac))))
    j = ordd.join(few_rows(first, GROUPS), by)  # a row per group
    return j.where(F.col("_o") - F.col("_first") < k).drop("_o", "_first", "_nneg", "_all")


def pairwise_loss(df: DataFrame, label: str, z: str, by: list[str] | None = None,
                  num_neg_per_pos: int = 8, seed: int = 777, rid: str = "rid",
                  hard_frac: float = 0.0) -> DataFrame:
    """Mean softplus(-(z_pos - z_neg)) over pairs: every positive with r negatives drawn by
    hash.  With ``hard_frac`` > 0 (and more than 10 negatives) the slots of all positives,
    numbered through, first take the max(1, hard_frac * N) negatives of largest logit, each
    once, and draw only beyond them.

    A training batch of the reference can be too small to give every positive its
    negatives and then leaves positives out; over a whole table all of them are used."""
    by = list(by or [])
    if not by:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    r = int(num_neg_per_pos)
    base = df.select(*by, rid, F.col(label).cast("int").alias("_cls"), F.col(z).alias("_z"))
    idx = class_index(base, "_cls", rid, by=by)
    cnt = idx.groupBy(*by).agg(F.sum(1 - F.col("_cls")).alias("_N"))
    pos = idx.where(F.col("_cls") == 1).join(few_rows(cnt, GROUPS), by)  # a row per group
    pairs = pos.select(*by, F.col("_z").alias("_zp"), "idx", "_N", F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("_t"))
    pick = draw([seed, *[F.col(c) for c in by], F.col("idx"), F.col("_t")], F.col("_N"))
    negs = idx.where(F.col("_cls") == 0).select(*by, F.col("idx").alias("_nidx"), F.col("_z").alias("_zn"))
    if hard_frac > 0:
        neg = base.where(F.col("_cls") == 0)
        ranked = global_ordinal(neg, [F.desc("_z"), F.col(rid)], "_h", by=by, few_groups=True)
        hard_n = F.when(F.col("_N") > 10, F.greatest(F.lit(1), F.floor(F.col("_N") * F.lit(float(hard_frac))))).otherwise(F.lit(0))
        slot = F.col("idx") * r + F.col("_t")
        pairs = pairs.withColumn("_hard", slot < hard_n).withColumn("_nidx", F.when(F.col("_hard"), slot).otherwise(pick))
        negs = negs.withColumn("_hard", F.lit(False)).unionByName(
            ranked.select(*by, F.col("_h").alias("_nidx"), F.col("_z").alias("_zn"), F.lit(True).alias("_hard")))
        j = pairs.join(negs, by + ["_nidx", "_hard"])
    else:
        j = pairs.withColumn("_nidx", pick).join(negs, by + ["_nidx"])
    out = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"),
                             F.avg(softplus(-(F.col("_zp") - F.col("_zn")))).alias("loss"))
    return out.drop("_all")
