"""No caps, no single-task statistics, plans that do not grow with the number of models."""

import math
import re

import pytest
from pyspark.sql import functions as F

from clickstack.functions.sequence import counted_positions, parse_lenient
from clickstack.operators import calibrate as ca
from clickstack.operators import features as fe
from clickstack.operators import folds as fo
from clickstack.operators import models as mo
from clickstack.operators import profile as pr
from clickstack.operators import sampling as sa
from clickstack.sources import fixtures as fx
from clickstack.sources import shards as sh
from clickstack.sources import tables as tb
from conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("target", [0.001, 0.005, 0.1, 0.5, 0.9])
def test_buckets_meet_their_target(spark, target):
    ns = [2, 3, 17, 1000, 10**6, 10**9]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = df.select("n", pr.recommended_buckets(F.col("n"), target, unit=1).alias("m")).collect()
    ratio = lambda n, m: 1 + m / n * math.expm1(-n / m)
    for r in got:
        assert ratio(r.n, r.m) <= target * (1 + 1e-9)
        assert r.m <= 2 or ratio(r.n, r.m - 1) > target * (1 - 1e-6) or r.n < 100
    assert df.limit(1).select(pr.recommended_buckets(F.lit(1), target)).first()[0] == 1


def test_medians_need_no_single_task(spark):
    df = spark.createDataFrame([(float(i % 7), None if i % 3 else float(i), math.nan if i < 8 else 1.0) for i in range(10)],
                               "a double, b double, c double")
    med = fe.median_values(df, ["a", "b", "c"])
    out = df.select(*[med[c].alias(c) for c in "abc"])
    assert "percentile" not in plan(out).lower() and "median" not in plan(out).lower()
    want = df.agg(*[F.median(c).alias(c) for c in "abc"]).first()
    r = out.first()
    assert (r.a, r.b) == (want.a, want.b) and r.c == 0.0  # a NaN median is 0


def test_ensemble_scans_the_rows_once(spark):
    rows = fx.train(spark, SMALL).select("rid", "clicked", F.col("k").cast("double").alias("k"), "inventory_id")
    d = mo.design(rows, ["inventory_id"], ["k"], 64).withColumn("ID", F.col("rid").cast("string"))
    path = sh.scratch_path(spark, "design")
    d.write.parquet(path)
    d = spark.read.parquet(path)
    model = mo.fit(d, "clicked", "lr", max_iter=2)
    for n in (5, 10):
        p = plan(mo.score_ensemble(d, [model] * n, None, calibrate=False))
        assert len(re.findall("Scan parquet", p)) == 1 and "Join" not in p
    both = mo.score_ensemble(d, [model] * 3, None, calibrate=False).join(mo.score(model, d, ["ID"]), "ID").collect()
    assert all(r.clicked == pytest.approx(r.p, abs=1e-6) for r in both)


def test_gaps_in_out_of_fold_scores_are_told(spark):
    rows = spark.range(10).withColumnRenamed("id", "rid")
    oof = rows.select("rid", (F.col("rid") % 3).alias("fold"), F.lit(0.5).alias("z"))
    assert mo.checked_oof(rows, oof) is oof
    for bad, said in ((oof.where("rid <> 4"), "1 rows without"), (oof.unionByName(oof.where("rid = 2")), "1 with several"),
                      (oof.withColumn("z", F.when(F.col("rid") > 1, F.col("z"))), "2 rows without"),
                      (oof.withColumn("rid", F.col("rid") + 1), "1 scores of unknown")):
        with pytest.raises(ValueError, match=said):
            mo.checked_oof(rows, bad)


def test_temperature_is_clamped_where_it_is_applied(spark):
    z = spark.createDataFrame([(3.5,)], "z double")
    p = lambda cal: z.select(cal.proba(F.col("z"))).first()[0]
    assert p(ca.Calibrator(T=7.0)) == pytest.approx(1 / (1 + math.exp(-0.7)))
    assert p(ca.Calibrator(T=7.0, clamp=None)) == pytest.approx(1 / (1 + math.exp(-0.5)))


def test_temperature_without_a_clamp_has_no_bounds(spark):
    # logits 20,000 times too large: the best T lies beyond any fixed bracket
    rows = [(20_000.0 * (1 if i % 4 else -1), int(i % 4 != 0) if i % 10 else int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "z double, y int")
    t, _ = ca.fit_temperature(df, "z", "y", l2=0.0, clamp=None)
    assert t > 5000
    assert 0.2 <= ca.fit_temperature(df, "z", "y", l2=0.0)[0] <= 5.0


def test_knots_are_interpolated(spark):
    import numpy as np
    xs, ys = [0.1, 0.2, 0.2, 0.5, 0.9], [0.0, 0.1, 0.3, 0.3, 1.0]
    ps = [0.0, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0]
    knots = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    got = ca.interpolate(spark.createDataFrame([(p,) for p in ps], "p double"), "p", knots, "v").orderBy("p").collect()
    assert [r.v for r in got] == pytest.approx(list(np.interp(ps, xs, ys)))


def test_every_fold_number_is_kept(spark):
    g = fo.with_group(fx.train(spark, SMALL), ["inventory_id", "day_of_week"], "md5")
    for n in (2, 3, 7):
        assert fo.stratified_group_fold_map(g, "clicked", n).select("fold").distinct().count() == n
    with pytest.raises(ValueError):
        fo.stratified_group_fold_map(g, "clicked", 1)


def test_every_positive_is_paired(spark):
    df = spark.createDataFrame([(i, int(i < 50), float(i % 7)) for i in range(80)], "rid long, y int, z double")
    for hard in (0.0, 0.3):
        assert sa.pairwise_loss(df, "y", "z", num_neg_per_pos=8, hard_frac=hard).first()["n_pairs"] == 400
    # all slots hard: the largest negatives, each once, then draws
    loss = sa.pairwise_loss(df, "y", "z", num_neg_per_pos=1, hard_frac=1.0).first()["loss"]
    assert loss > 0


def test_draws_reach_beyond_32_bits(spark):
    top = spark.range(200).select(sa.draw([1, F.col("id")], F.lit(1 << 60)).alias("d")).agg(F.max("d")).first()[0]
    assert top > 1 << 55


def test_batches_without_replacement_are_not_neighbours(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(400)], "rid long, y int")
    b = sa.balanced_batches(df, "y", 20, 0.5, replacement=False, seed=3)
    assert b.groupBy("batch", "rid").count().where("count > 1").count() == 0
    ids = sorted(r.rid for r in b.where("batch = 0 and slot < 10").collect())
    assert ids[-1] - ids[0] > 40  # not a run of neighbouring rows


def test_long_ids_are_kept(spark):
    df = spark.createDataFrame([("a" * 100 + "1", 1), ("a" * 100 + "2", 2)], "ID string, rid long")
    assert df.select(fe.normalised_id(df).alias("i")).distinct().count() == 2


def test_junk_takes_no_position(spark):
    df = spark.createDataFrame([("1,x,3",), ("x,5",), ("",), (None,)], "s string")
    got = [[tuple(t) for t in r[0]] for r in df.select(counted_positions(parse_lenient("s"))).collect()]
    assert got == [[(0, 1), (0, None), (1, 3)], [(-1, None), (0, 5)], [(-1, None)], []]


def test_caches_of_train_and_test(spark):
    spec = fe.FeatureSpec(num_patterns=("x",), hash_mode="md5", max_len=2)
    train = spark.createDataFrame([(i, 1, float(i)) for i in range(9)], "rid long, clicked int, x double")
    test = spark.createDataFrame([(i, None if i == 0 else 100.0 + i, 0.5) for i in range(4)], "rid long, x double, c double")
    for fit_on, want in (("train", 4.0), ("each", 102.0)):
        out = sh.scratch_path(spark, "caches")
        a, b = sh.write_caches(train, test, spec, out, 4, fit_on)
        assert (a.count(), b.count()) == (3, 1)
        first = sh.read_block(spark, f"{out}/test").where("rid = 0").first()
        assert first.X_num[0] == want and first.X_mask[0] == 1
    with pytest.raises(TypeError):
        fe.fit(train.withColumn("s", F.lit("a")), spec, joined=("s",))


def test_a_source_without_the_column_is_skipped(spark, caplog):
    paths = [f"{SMALL}/{t}.parquet" for t in ("labels", "events")]
    assert tb.union_key_sources(spark, paths, "doc_id").count() == spark.read.parquet(paths[0]).count()
    assert "events" in caplog.text
    with pytest.raises(ValueError):
        tb.union_key_sources(spark, paths[1:], "doc_id")
