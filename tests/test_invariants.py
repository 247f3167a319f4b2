"""Invariants and brute-force checks on the fixture and on random tables."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickstack.operators import calibrate as ca
from clickstack.operators import covis as cv
from clickstack.operators import ensemble as en
from clickstack.operators import metrics as me
from clickstack.operators import sampling as sa
from clickstack.operators.folds import attach_folds, group_folds, stratified_group_fold_map, with_group
from clickstack.operators.rowindex import contiguous_rid, global_ordinal
from clickstack.plans.covis_queries import SPEC
from clickstack.sources import fixtures as fx
from conftest import MID, SMALL


def _train_folds(spark, sf=SMALL):
    return attach_folds(fx.train(spark, sf), list(SPEC.fold_group), SPEC.n_folds, "md5")


def test_groups_never_straddle_folds(spark):
    tr = fx.train(spark, SMALL)
    f = group_folds(tr, ["inventory_id", "day_of_week"], 5, "md5")
    j = tr.join(f, "rid").groupBy("inventory_id", "day_of_week").agg(F.countDistinct("fold").alias("n"))
    assert j.where("n > 1").count() == 0
    g = with_group(tr, ["inventory_id", "day_of_week"], "md5")
    sf = g.join(stratified_group_fold_map(g, "clicked", 5), "g")
    assert sf.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert sf.select("fold").distinct().count() == 5


def test_subtraction_equals_filter_form(spark):
    tr = _train_folds(spark)
    tok = cv.token_rows(tr, SPEC, keep=["fold", "clicked"]).cache()
    oof = cv.pair_stats_oof(tok, SPEC)
    for f in range(SPEC.n_folds):
        direct = cv.pair_stats_full(tok.where(F.col("fold") != f), SPEC)
        a = {tuple(r[:4]): r for r in oof.where(F.col("fold") == f).drop("fold").collect()}
        b = {tuple(r[:4]): r for r in direct.collect()}
        assert a.keys() == b.keys() and len(a) > 0
        for k in a:
            x, y = a[k], b[k]
            assert (x["impr"], x["clicks"], x["max_pos"]) == (y["impr"], y["clicks"], y["max_pos"])
            assert x["w_rec_sum"] == pytest.approx(y["w_rec_sum"], rel=1e-9)
            assert x["ctr"] == pytest.approx(y["ctr"], rel=1e-9)
    tok.unpersist()


def test_own_label_never_leaks(spark):
    tr = _train_folds(spark)
    target_rid = tr.where("seq is not null").orderBy("rid").first()["rid"]
    flipped = tr.withColumn("clicked", F.when(F.col("rid") == target_rid, 1 - F.col("clicked"))
                            .otherwise(F.col("clicked")))

    def feats(df):
        tok = cv.token_rows(df, SPEC, keep=["fold", "clicked"])
        return cv.row_features(df, cv.pair_stats_oof(tok, SPEC), SPEC, ["rid"], join_fold=True)
    a = feats(tr).where(F.col("rid") == target_rid).first()
    b = feats(flipped).where(F.col("rid") == target_rid).first()
    assert a["l_feat_14_sum_impr"] > 0
    for c in SPEC.feature_columns():
        assert a[c] == pytest.approx(b[c], rel=1e-12, abs=1e-15)


def test_batches_have_exact_class_mix(spark):
    tr = fx.train(spark, SMALL)
    for repl in (True, False):
        b = sa.balanced_batches(tr, "clicked", 16, 0.25, replacement=repl, seed=1, epoch=2)
        j = b.join(tr.select("rid", "clicked"), "rid")
        mix = j.groupBy("batch").agg(F.sum("clicked").alias("p"), F.count(F.lit(1)).alias("n")).collect()
        assert len(mix) == tr.count() // 16
        assert all(r["p"] == 4 and r["n"] == 16 for r in mix)
        if not repl:
            dup = b.groupBy("batch", "rid").count().where("count > 1").count()
            assert dup == 0
    again = sa.balanced_batches(tr, "clicked", 16, 0.25, seed=1, epoch=2)
    first = sa.balanced_batches(tr, "clicked", 16, 0.25, seed=1, epoch=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))


def _ap_numpy(y, p):
    order = np.argsort(-p, kind="mergesort")
    y, p = y[order], p[order]
    tp = np.cumsum(y)
    n = np.arange(1, len(y) + 1)
    last = np.r_[p[1:] != p[:-1], True]
    prec, rec = tp[last] / n[last], tp[last] / y.sum()
    return float(np.sum(np.diff(np.r_[0, rec]) * prec))


def test_average_precision_brute_force_and_invariance(spark):
    rng = np.random.default_rng(7)
    y = (rng.uniform(size=3000) < 0.2).astype(int)
    p = np.round(rng.uniform(size=3000) * 0.5 + 0.3 * y, 3)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    got = me.average_precision(df, "y", "p").first()["ap"]
    assert got == pytest.approx(_ap_numpy(y, p), rel=1e-12)
    mono = df.withColumn("p", F.col("p") * F.col("p") * 0.5)
    assert me.average_precision(mono, "y", "p").first()["ap"] == pytest.approx(got, rel=1e-12)


def test_temperature_fit_matches_dense_scan(spark):
    s = fx.scores(spark, MID).select("z", "clicked").toPandas()
    z, y = s["z"].to_numpy(), s["clicked"].to_numpy()
    ts = np.exp(np.linspace(np.log(0.2), np.log(5), 20001))

    def loss(t):
        p = np.clip(1 / (1 + np.exp(-z / t)), 1e-7, 1 - 1e-7)
        return 0.5 * (-np.log(p[y == 1]).mean() - np.log(1 - p[y != 1]).mean()) + 1e-3 * (t - 1) ** 2
    best = ts[np.argmin([loss(t) for t in ts[::20]]) * 20]
    t, _ = ca.fit_temperature(fx.scores(spark, MID), "z", "clicked")
    assert t == pytest.approx(best, rel=5e-3)
    assert t == pytest.approx(0.4286, abs=2e-3)


def _pav(x, y, w):
    # tied x values are pooled first (weighted mean), then adjacent violators merge
    ux, inv = np.unique(x, return_inverse=True)
    sw = np.bincount(inv, weights=w)
    swy = np.bincount(inv, weights=w * y)
    blocks = []  # [sum_wy, sum_w, x_lo, x_hi]
    for xi, wyi, wi in zip(ux, swy, sw):
        blocks.append([wyi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1][0] += b[0]; blocks[-1][1] += b[1]; blocks[-1][3] = b[3]
    return blocks


def test_isotonic_matches_pav_and_is_monotone(spark):
    s = fx.scores(spark, MID).withColumn("pz", ca.sigmoid_stable(F.col("z")))
    knots = ca.isotonic_knots(s, "pz", "clicked").orderBy("x").collect()
    pdf = s.select("pz", "clicked").toPandas()
    x, y = pdf["pz"].to_numpy(), pdf["clicked"].to_numpy().astype(float)
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    blocks = _pav(x, y, w)
    # every knot value is one of the PAV block means
    means = sorted(b[0] / b[1] for b in blocks)
    for k in knots:
        assert min(abs(k["y"] - m) for m in means) < 1e-9
    ys = [k["y"] for k in knots]
    assert ys == sorted(ys)
    cal = ca.Calibrator("isotonic", knots=spark.createDataFrame([(k["x"], y) for k, y in zip(knots, ys)], "x double, y double"))
    out = cal.apply(s.select("z"), "z", "p").orderBy("z").toPandas()
    assert np.all(np.diff(out["p"].to_numpy()) >= -1e-15)


def test_rank_average_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.uniform(size=(500, 3)), 2)
    df = spark.createDataFrame([(f"{i:04d}", *map(float, r)) for i, r in enumerate(v)],
                               "ID string, a double, b double, c double")
    got = {r["ID"]: r["p"] for r in en.combine(df, ["a", "b", "c"], "rank_avg", clamp=False).collect()}
    ids = np.array([f"{i:04d}" for i in range(500)])
    exp = np.zeros(500)
    for j in range(3):
        order = np.lexsort((ids, v[:, j]))
        r = np.empty(500); r[order] = np.arange(500)
        exp += (r + 1) / 501
    exp /= 3
    for i in range(500):
        assert got[ids[i]] == pytest.approx(exp[i], rel=1e-12)


def test_row_numbering_equals_row_number(spark):
    df = spark.range(0, 5000, 3).withColumn("k", (F.col("id") * 7919) % 10007)
    w = Window.orderBy("k")
    exp = {r["k"]: r["o"] for r in df.select("k", (F.row_number().over(w) - 1).alias("o")).collect()}
    a = {r["k"]: r["o"] for r in global_ordinal(df, ["k"], "o").collect()}
    b = {r["k"]: r["o"] for r in contiguous_rid(df, "k", "o").collect()}
    assert a == exp and b == exp


def test_hard_negatives_count(spark):
    s = attach_folds(fx.scores(spark, SMALL), ["inventory_id", "day_of_week"], 5, "md5")
    h = sa.hard_negatives(s, "clicked", "z", 0.1, by=["fold"])
    per = {r["fold"]: r["n"] for r in h.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    neg = {r["fold"]: r["n"] for r in s.where("clicked <> 1").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for f in neg:
        assert per[f] == max(1, int(neg[f] * 0.1))


def test_grouped_temperature_equals_per_group(spark):
    s = attach_folds(fx.scores(spark, SMALL), ["inventory_id", "day_of_week"], 5, "md5")
    by = ca.fit_temperature_by(s, "z", "clicked", "fold", [0, 1, 2])
    for f in (0, 1, 2):
        t, _ = ca.fit_temperature(s.where(F.col("fold") == f), "z", "clicked")
        assert by[f] == pytest.approx(t, rel=1e-12)


def test_full_stats_from_fold_table(spark):
    tok = cv.token_rows(_train_folds(spark), SPEC, keep=["fold", "clicked"]).cache()
    a = {tuple(r[:4]): tuple(r[4:]) for r in cv.pair_stats_full(tok, SPEC).collect()}
    b = {tuple(r[:4]): tuple(r[4:]) for r in cv.pair_stats_full_from_wide(cv.pair_stats_wide(tok, SPEC), SPEC).collect()}
    assert a.keys() == b.keys() and len(a) > 0
    for k in a:
        assert a[k][0:2] == b[k][0:2] and a[k][3] == b[k][3]
        assert a[k][2] == pytest.approx(b[k][2], rel=1e-9) and a[k][4] == pytest.approx(b[k][4], rel=1e-12)
    tok.unpersist()
