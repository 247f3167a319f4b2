"""Registered fold and sampling queries (2.8, 2.6 #4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as sa
from ..operators.folds import attach_folds, holdout, stratified_group_fold_map, with_group
from ..sources import fixtures as fx
from . import oracle_base as ob
from .registry import register

IT = [ob.IMPRESSIONS, ob.TRAIN]
# The greedy rule, one leftover group of a profile after the other.
_EVAL = """list_transform(range(5), lambda f: {'spread': round((list_stddev_pop(list_transform(range(5), lambda j: (h[j + 1].p + CASE WHEN j = f THEN pos ELSE 0 END) / tp))
  + list_stddev_pop(list_transform(range(5), lambda j: (h[j + 1].n + CASE WHEN j = f THEN neg ELSE 0 END) / tn))) / 2, 12), 'total': h[f + 1].p + h[f + 1].n, 'f': f})"""
SGF = f"""sg AS (SELECT *, {ob.group_hash(['inventory_id', 'day_of_week'])} AS g FROM train),
pg AS (SELECT g, sum(clicked) AS pos, count(*) AS n FROM sg GROUP BY g),
rk AS (SELECT g, pos, n, row_number() OVER (PARTITION BY pos, n ORDER BY
              {ob.md5_u32("concat_ws(chr(31), '777', CAST(g AS VARCHAR))")}, g) - 1 AS i, count(*) OVER (PARTITION BY pos, n) AS m FROM pg),
lo AS (SELECT g, pos::DOUBLE AS pos, (n - pos)::DOUBLE AS neg,
              row_number() OVER (ORDER BY abs(2 * pos - n) DESC, n DESC, pos DESC, i) AS s FROM rk WHERE i >= m - m % 5),
tt AS (SELECT greatest(sum(pos), 1)::DOUBLE AS tp, greatest(sum(n - pos), 1)::DOUBLE AS tn FROM pg),
dl AS (SELECT 0::BIGINT AS s, NULL::BIGINT AS g, NULL::BIGINT AS fold, list_transform(range(5), lambda j: {{'p': 0::DOUBLE, 'n': 0::DOUBLE}}) AS h
       UNION ALL
       SELECT s, g, fold, list_transform(range(5), lambda j: {{'p': h[j + 1].p + CASE WHEN j = fold THEN pos ELSE 0 END,
                                                         'n': h[j + 1].n + CASE WHEN j = fold THEN neg ELSE 0 END}}) AS h
       FROM (SELECT lo.s, lo.g, lo.pos, lo.neg, h, list_min({_EVAL}).f AS fold FROM dl JOIN lo ON lo.s = dl.s + 1, tt)),
fm AS (SELECT rk.g, coalesce(dl.fold, i % 5)::INT AS fold FROM rk LEFT JOIN dl ON dl.g = rk.g),
sgf AS (SELECT sg.*, fm.fold FROM sg JOIN fm USING (g))"""


def strat_folds(spark, sf_dir):
    tr = with_group(fx.train(spark, sf_dir), ["inventory_id", "day_of_week"], "md5")
    fmap = stratified_group_fold_map(tr, "clicked", 5, seed=777)
    return tr.join(fmap, "g")


@register("stratified_group_folds", ob.query(IT + [SGF], "SELECT rid, fold FROM sgf", recursive=True))
def q_stratified_group_folds(spark, sf_dir):
    """Groups dealt greedily to the fold that keeps the classes' shares most even; a group never
    straddles folds (2.8 #2, D2)."""
    return strat_folds(spark, sf_dir).select("rid", "fold")


@register("holdout_split", ob.query(IT + [SGF], "SELECT rid, fold, (fold = 0)::INT AS is_valid FROM sgf", recursive=True))
def q_holdout_split(spark, sf_dir):
    """n_splits == 1: fold 0 of 5 is the validation part (2.8 #3)."""
    return holdout(strat_folds(spark, sf_dir).select("rid", "fold"))


BB = f"""cn AS (SELECT sum(clicked)::BIGINT AS np, sum(1 - clicked)::BIGINT AS nn, count(*)::BIGINT AS n FROM train),
sl AS (SELECT r.range // 64 AS batch, r.range % 64 AS slot FROM cn, range((cn.n // 64) * 64) r),
sp AS (SELECT batch, slot, CASE WHEN slot < 32 THEN 1 ELSE 0 END AS cls,
              {ob.md5_u60("concat_ws(chr(31), '777', '0', CAST(batch AS VARCHAR), CAST(slot AS VARCHAR))")}
              % (CASE WHEN slot < 32 THEN np ELSE nn END) AS idx FROM sl, cn),
ci AS (SELECT rid, clicked AS cls, row_number() OVER (PARTITION BY clicked ORDER BY rid) - 1 AS idx FROM train)"""


@register("balanced_batches", ob.query(IT + [BB], "SELECT batch::BIGINT AS batch, slot::BIGINT AS slot, rid FROM sp JOIN ci USING (cls, idx)"))
def q_balanced_batches(spark, sf_dir):
    """Balanced batches (bs 64, half positives) with replacement, md5 draws joined to
    per-class row indices (2.8 #4)."""
    return sa.balanced_batches(fx.train(spark, sf_dir), "clicked", 64, 0.5, seed=777, epoch=0)


def _feistel_sql(x: str, n: str, key: str) -> str:
    """The keyed permutation of [0, n) in SQL, with the same rounds and walk."""
    b = f"ceil(sqrt({n}))::BIGINT"
    a = f"(({n} + {b} - 1) // {b})"
    f = lambda half, r: ob.md5_u60(f"concat_ws(chr(31), {key}, '{r}', CAST({half} AS VARCHAR))")
    left, right = f"({x} // {b})", f"({x} % {b})"
    for r in range(4):
        if r % 2 == 0:
            left = f"(({left} + {f(right, r)}) % {a})"
        else:
            right = f"(({right} + {f(left, r)}) % {b})"
    return f"({left} * {b} + {right})"


FB = f"""cn AS (SELECT sum(clicked)::BIGINT AS np, sum(1 - clicked)::BIGINT AS nn, count(*)::BIGINT AS n FROM train),
sl AS (SELECT r.range // 64 AS batch, r.range % 64 AS slot FROM cn, range((cn.n // 64) * 64) r),
so AS (SELECT batch, slot, (slot < 32)::INT AS cls, CASE WHEN slot < 32 THEN slot ELSE slot - 32 END AS j,
              CASE WHEN slot < 32 THEN np ELSE nn END AS pool FROM sl, cn),
s0 AS (SELECT *, {_feistel_sql('j', 'pool', "'777', '0', CAST(batch AS VARCHAR), CAST(cls AS VARCHAR)")} AS y FROM so),
sp AS (SELECT batch, slot, cls, pool, y FROM s0 UNION ALL
       SELECT batch, slot, cls, pool, {_feistel_sql('y', 'pool', "'777', '0', CAST(batch AS VARCHAR), CAST(cls AS VARCHAR)")} FROM sp WHERE y >= pool),
ci AS (SELECT rid, clicked AS cls, row_number() OVER (PARTITION BY clicked ORDER BY rid) - 1 AS idx FROM train)"""


@register("balanced_batches_unique", ob.query(IT + [FB], "SELECT batch::BIGINT AS batch, slot::BIGINT AS slot, rid FROM sp JOIN ci ON ci.cls = sp.cls AND ci.idx = sp.y WHERE sp.y < sp.pool", recursive=True))
def q_balanced_batches_unique(spark, sf_dir):
    """Balanced batches without replacement: a keyed permutation of each class per batch (2.8 #4)."""
    return sa.balanced_batches(fx.train(spark, sf_dir), "clicked", 64, 0.5, replacement=False, seed=777, epoch=0)


@register("hash_sample", ob.query(IT, f"""SELECT rid FROM train
WHERE {ob.md5_u60("concat_ws(chr(31), '2025', coalesce(CAST(rid AS VARCHAR), 'NA'))")} / 1152921504606846976.0 < 0.3"""))
def q_hash_sample(spark, sf_dir):
    """Reproducible 30% sample by a hash of (seed, key) (2.8 #5)."""
    return sa.hash_sample(fx.train(spark, sf_dir), ["rid"], 0.3, seed=2025).select("rid")


SF = [ob.IMPRESSIONS, ob.SCORES, ob.folds_cte("scores", name="sf")]


def scores_folds(spark, sf_dir):
    return attach_folds(fx.scores(spark, sf_dir), ["inventory_id", "day_of_week"], 5, "md5")


@register("hard_negatives", ob.query(SF + [
    """rk AS (SELECT rid, fold, z, row_number() OVER (PARTITION BY fold ORDER BY z DESC, rid) - 1 AS o,
                count(*) OVER (PARTITION BY fold) AS nn FROM sf WHERE clicked <> 1)"""],
    "SELECT rid, fold, z FROM rk WHERE o < greatest(1, floor(nn * 0.1))", ["z"]))
def q_hard_negatives(spark, sf_dir):
    """Top 10% negatives by logit per fold (2.6 #4)."""
    s = scores_folds(spark, sf_dir).select("rid", "fold", "clicked", "z")
    return sa.hard_negatives(s, "clicked", "z", 0.1, by=["fold"]).select("rid", "fold", "z")


_PAIRS = [
    """ix AS (SELECT fold, rid, clicked AS cls, z, row_number() OVER (PARTITION BY fold, clicked ORDER BY rid) - 1 AS idx,
              row_number() OVER (PARTITION BY fold, clicked ORDER BY z DESC, rid) - 1 AS h FROM sf),
cnt AS (SELECT fold, sum(1 - cls)::BIGINT AS "N" FROM ix GROUP BY fold),
pos AS (SELECT ix.fold, ix.idx, ix.z AS zp, cnt."N" FROM ix JOIN cnt USING (fold) WHERE cls = 1),
pairs AS (SELECT fold, zp, idx * 8 + t.range AS slot, "N", """
    + ob.md5_u60("concat_ws(chr(31), '777', CAST(fold AS VARCHAR), CAST(idx AS VARCHAR), CAST(t.range AS VARCHAR))")
    + """ % "N" AS nidx FROM pos, range(8) t),
negs AS (SELECT fold, idx, h, z AS zn FROM ix WHERE cls = 0)"""]
_LOSS = "count(*)::BIGINT AS n_pairs, avg(ln(1 + exp(-abs(-(zp - zn)))) + greatest(-(zp - zn), 0)) AS loss"


@register("pairwise_loss", ob.query(SF + _PAIRS, f"""SELECT pairs.fold AS fold, {_LOSS}
FROM pairs JOIN negs ON pairs.fold = negs.fold AND negs.idx = nidx GROUP BY pairs.fold""", ["loss"]))
def q_pairwise_loss(spark, sf_dir):
    """Pairwise logistic loss: every positive with 8 hashed negatives, per fold (2.8 #6)."""
    s = scores_folds(spark, sf_dir).select("rid", "fold", "clicked", "z")
    return sa.pairwise_loss(s, "clicked", "z", by=["fold"], num_neg_per_pos=8, seed=777)


@register("pairwise_loss_hard", ob.query(SF + _PAIRS, f"""SELECT pairs.fold AS fold, {_LOSS}
FROM pairs JOIN negs ON pairs.fold = negs.fold AND CASE WHEN slot < (CASE WHEN "N" > 10 THEN greatest(1, floor("N" * 0.3)) ELSE 0 END)
     THEN negs.h = slot ELSE negs.idx = nidx END GROUP BY pairs.fold""", ["loss"]))
def q_pairwise_loss_hard(spark, sf_dir):
    """The same with the hardest 30% of negatives taken first (2.8 #6)."""
    s = scores_folds(spark, sf_dir).select("rid", "fold", "clicked", "z")
    return sa.pairwise_loss(s, "clicked", "z", by=["fold"], num_neg_per_pos=8, seed=777, hard_frac=0.3)
