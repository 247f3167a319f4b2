"""Medians by bracket and count, isotonic fits by merged minorants, as-of joins, numbering by file
position, greedy folds, keyed permutations: each against a plain version of itself."""

import math
import re
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickstack.operators import asof, folds, isotonic, medians, profile, rowindex, sampling
from clickstack.operators import calibrate as ca
from clickstack.operators import covis as cv
from clickstack.operators import history as hi
from clickstack.sources import shards as sh


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def middle(values):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    a, b = v[(len(v) - 1) // 2], v[len(v) // 2]
    return a if a == b or math.isnan(a) and math.isnan(b) else (a + b) / 2


@pytest.mark.parametrize("accuracy,open_values", [(10_000, 20_000), (200, 5)])
def test_medians_are_exact(spark, monkeypatch, accuracy, open_values):
    monkeypatch.setattr(medians, "ACCURACY", accuracy)
    monkeypatch.setattr(medians, "OPEN_VALUES", open_values)
    rng = np.random.default_rng(1)
    n, inf, nan = 20_001, math.inf, math.nan
    cols = {"a": rng.normal(size=n), "b": np.round(rng.normal(size=n), 1), "c": rng.integers(0, 2, n) * 1.0,
            "d": np.where(rng.random(n) < 0.7, 5.0, rng.random(n)), "e": rng.choice([nan, inf, -inf, 1.0], n, p=[.3, .3, .2, .2]),
            "f": rng.choice([nan, 2.0], n, p=[.6, .4]), "g": np.full(n, nan), "h": rng.choice([inf, nan], n, p=[.51, .49]),
            "i": np.concatenate([np.zeros(n // 2), np.ones(n - n // 2)]), "j": rng.permutation(n) * 1.0}
    names = list(cols)
    df = spark.createDataFrame([tuple(None if k % 3 == 0 and c in "bj" else float(cols[c][k]) for c in names) + (None,) for k in range(n)],
                               ", ".join(f"{c} double" for c in names) + ", z double").repartition(7)
    for part in (df, df.limit(n - 1), df.limit(2), df.limit(1), df.limit(0)):
        part = part.cache()
        rows = part.collect()
        got = medians.middle_values(part, [*names, "z"])
        for c in [*names, "z"]:
            want = middle([r[c] for r in rows])
            assert got[c] == want or math.isnan(got[c]) and math.isnan(want), (c, got[c], want, len(rows))
        part.unpersist()


def pav(points):
    out = []
    for p, n, pos in sorted(points):
        out.append([p, p, n, pos])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi_, m, q = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = hi_, out[-1][2] + m, out[-1][3] + q
    return [tuple(x) for x in out]


@pytest.mark.parametrize("edges", [200_000, 20, 1])
def test_pools_equal_pool_adjacent_violators(spark, edges):
    rng = np.random.default_rng(edges)
    for shape in (lambda p: p, lambda p: 0.5, lambda p: float(p > 0.5), lambda p: 1 - p):
        ps = np.unique(np.round(rng.random(3000), 4))
        pts = [(float(p), int(n), int(rng.binomial(n, shape(p)))) for p, n in zip(ps, rng.integers(1, 4, len(ps)))]
        df = spark.createDataFrame(pts, "p double, n long, pos long").repartition(5)
        assert sorted(tuple(r) for r in isotonic.pools(df, "p", "n", "pos", edges).collect()) == pav(pts)
    for few in ([(0.3, 2, 1)], [(0.1, 1, 0), (0.2, 1, 1)], [(0.1, 1, 1), (0.2, 1, 0)], []):
        df = spark.createDataFrame(few, "p double, n long, pos long")
        assert sorted(tuple(r) for r in isotonic.pools(df, "p", "n", "pos", edges).collect()) == pav(few)


def test_isotonic_fit_of_a_million_scores(spark):
    df = spark.range(1_000_000).select((F.col("id") / 1e6).alias("p"), (F.xxhash64("id") % 1000 < F.col("id") / 500 - 1000).cast("int").alias("y"))
    knots = ca.isotonic_knots(df, "p", "y").orderBy("x").collect()
    ys = [k.y for k in knots]
    assert ys == sorted(ys) and 10 < len(ys) < 10_000 and ys[0] < 0.1 and ys[-1] > 0.9
    rows = df.collect()
    want = pav([(r.p, 1, r.y) for r in rows])
    assert [k.x for k in knots] == sorted({x for w in want for x in w[:2]})


def test_as_of_join(spark):
    rng = np.random.default_rng(4)
    at = sorted(set(rng.integers(0, 400, 60).tolist()))
    xs = [None, -1, 500, *rng.integers(0, 400, 3000).tolist()] + [at[7]] * 2000
    marks = spark.createDataFrame([(float(a), i) for i, a in enumerate(at)], "at double, i long").repartition(3)
    rows = spark.createDataFrame([(k, None if x is None else float(x)) for k, x in enumerate(xs)], "k long, x double").repartition(6)
    got = {r.k: r for r in asof.between_marks(rows, "x", marks, "at").collect()}
    assert len(got) == len(xs)
    for k, x in enumerate(xs):
        b = [a for a in at if x is not None and a <= x]
        a = [a for a in at if x is not None and a > x]
        assert (got[k].before and got[k].before.at) == (b[-1] if b else None) and (got[k].after and got[k].after.at) == (a[0] if a else None)


def test_knots_do_not_enter_the_plan(spark):
    n = 100_000
    knots = spark.range(n).select((F.col("id") / n).alias("x"), F.pow(F.col("id") / n, F.lit(2.0)).alias("y"))
    rows = spark.createDataFrame([(i, (i + 0.5) / 10) for i in range(10)], "i long, p double")
    began = time.time()
    got = ca.interpolate(rows, "p", knots, "v").orderBy("i").collect()
    assert time.time() - began < 30
    assert [r.v for r in got] == pytest.approx([((i + 0.5) / 10) ** 2 for i in range(10)], abs=1e-4)
    small = ca.interpolate(rows, "p", knots.limit(5), "v")
    assert abs(len(plan(ca.interpolate(rows, "p", knots, "v"))) - len(plan(small))) < 2000


def test_grouped_temperature_without_a_clamp(spark):
    rows = [(g, s * (1 if i % 4 else -1), int(i % 4 != 0) if i % 10 else int(i % 4 == 0)) for g, s in ((0, 3.0), (1, 20_000.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, z double, y int")
    by = ca.fit_temperature_by(df, "z", "y", "fold", [0, 1, 2], l2=0.0, clamp=None)
    for f in (0, 1):
        t, _ = ca.fit_temperature(df.where(F.col("fold") == f), "z", "y", l2=0.0, clamp=None)
        assert by[f] == pytest.approx(t, rel=1e-3)
    assert by[1] > 5000 and by[2] == 1.0


def test_numbers_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(7).withColumn("v", F.col("id") * 2).write.parquet(path)
    scan = spark.read.parquet(path)
    df = rowindex.input_order(scan.select("id", "v"))
    place = sorted((r.f, r.i, r.id) for r in scan.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"), "id").collect())
    want = {x[2]: k for k, x in enumerate(place)}
    assert {r.id: r.rid for r in df.collect()} == want == {r.id: r.rid for r in rowindex.input_order(scan).collect()}
    exchanges = re.findall(r"Exchange (\w+)", plan(df))
    assert all(x == "SinglePartition" or "Broadcast" in x for x in exchanges) and "rangepartitioning" not in plan(df)
    some = rowindex.input_order(scan, "n", F.col("id") % 3 == 0).collect()
    kept = [x[2] for x in place if x[2] % 3 == 0]
    assert {r.id: r.n for r in some} == {i: kept.index(i) if i % 3 == 0 else None for i in range(1000)}


def test_shards_of_numbered_rows_need_no_range_exchange(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(5).write.parquet(path)
    man = sh.write_shards(rowindex.input_order(spark.read.parquet(path)), str(tmp_path / "cache"), 64).orderBy("shard").collect()
    assert [(m.start, m.end) for m in man] == [(s, min(s + 64, 1000)) for s in range(0, 1000, 64)]
    assert len(list((tmp_path / "cache" / "data").glob("shard=*/*.parquet"))) == len(man)


def spread(counts):
    rates = [p / max(1, n) for p, n in counts]
    return max(rates) - min(rates)


def usual_rule(groups, k, rng):
    """Greedy split of scikit-learn: groups shuffled, most uneven first."""
    order = rng.permutation(len(groups))
    order = sorted(order, key=lambda i: -np.std(groups[i]))
    total, held = np.sum(groups, axis=0), np.zeros((k, 2))
    for i in order:
        evals = []
        for f in range(k):
            held[f] += groups[i]
            evals.append((round(np.mean(np.std(held / total, axis=0)), 12), held[f].sum(), f))
            held[f] -= groups[i]
        held[min(evals)[2]] += groups[i]
    return [(p, p + n) for n, p in held]


@pytest.mark.parametrize("n_groups,sizes,k,block", [(126, (50, 200), 5, 10_000), (3000, (1, 6), 5, 10_000), (3000, (1, 40), 4, 50), (7, (1, 9), 5, 10_000)])
def test_greedy_folds(spark, n_groups, sizes, k, block):
    rng = np.random.default_rng(n_groups)
    n = rng.integers(*sizes, n_groups)
    pos = rng.binomial(n, rng.beta(1, 6, n_groups))
    rows = [(int(g), int(i < pos[g])) for g in range(n_groups) for i in range(n[g])]
    df = spark.createDataFrame(rows, "g long, y int")
    fold = {r.g: r.fold for r in folds.stratified_group_fold_map(df, "y", k, block=block).collect()}
    assert len(fold) == n_groups and set(fold.values()) <= set(range(k))
    counts = [[0, 0] for _ in range(k)]
    for g, f in fold.items():
        counts[f][0] += int(pos[g])
        counts[f][1] += int(n[g])
    usual = statistics.median(spread(usual_rule([(a - b, b) for a, b in zip(n, pos)], k, rng)) for _ in range(3 if n_groups < 500 else 1))
    assert spread(counts) <= usual + 2e-3
    assert folds.stratified_group_fold_map(df.limit(0), "y", k).collect() == []


def test_keyed_permutations(spark):
    for n in (1, 2, 3, 5, 16, 17, 100, 1000, 4097):
        x = spark.range(n).select(sampling.permuted(F.col("id"), F.lit(n).cast("long"), [7, 0]).alias("x"),
                                  sampling.permuted(F.col("id"), F.lit(n).cast("long"), [7, 1]).alias("y")).collect()
        assert sorted(r.x for r in x) == list(range(n)) == sorted(r.y for r in x)
        if n >= 100:
            assert sum(r.x == r.y for r in x) < 15 and [r.x for r in x] != list(range(n))


def test_batches_have_permutations_of_their_own(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(400)], "rid long, y int")
    b = sampling.balanced_batches(df, "y", 100, 0.5, num_batches=40, replacement=False, seed=3)
    assert b.groupBy("batch", "rid").count().where("count > 1").isEmpty()
    rows = b.collect()
    sets = {}
    for r in rows:
        sets.setdefault(r.batch, set()).add(r.rid)
    shared = [len(sets[i] & sets[i + 1]) for i in range(39)]
    assert 18 < statistics.mean(shared) < 32  # 50 of 200, twice: 25 in the mean; turns would share none
    with pytest.raises(ValueError):
        sampling.balanced_batches(df, "y", 500, 0.5, replacement=False)


def test_profile_counts_near_unique_columns_alone(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), F.col("id"))).alias("s"),
                                  F.lit(None).cast("double").alias("z"), (F.col("id") / 3).alias("d"))
    got = {r.col: r for r in profile.column_profile(df, df.columns).collect()}
    assert [got[c].n_unique for c in ("id", "k", "s", "z", "d")] == [1000, 7, 501, 1, 1000]
    assert (got["s"].null_count, got["z"].non_null, got["id"].frac_int_like, got["z"].frac_int_like) == (500, 0, 1.0, 0.0)
    assert got["d"].num_max == 333.0 and got["s"].num_max is None


def test_history_scores_shuffle_tokens_once(spark):
    emb = spark.range(50).select(F.col("id").alias("vec_id"), F.array(*[(F.sin(F.col("id") * (i + 1))).alias("e") for i in range(4)]).alias("embedding"))
    rows = spark.createDataFrame([(i, ",".join(str((i * j) % 40) for j in range(i % 9)), i % 3, i % 5, i % 7) for i in range(200)],
                                 "rid long, seq string, inventory_id int, day_of_week int, hour int")
    spec = hi.HistorySpec(max_len=5, dim=4, context_cols=("day_of_week", "hour"), query_offset=10, context_offsets={"day_of_week": 20, "hour": 30})
    few = {(r.rid, r.pos): r.score for r in hi.token_scores(rows, emb, spec).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(hi.token_scores(rows, emb, spec))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Generate posexplode") == 1 and len(re.findall(r"Exchange hashpartitioning\(token#\d+, \d+\)", p)) <= 2
    old, hi.MAP_VALUES = hi.MAP_VALUES, 0
    try:
        many = {(r.rid, r.pos): r.score for r in hi.token_scores(rows, emb, spec).collect()}
    finally:
        hi.MAP_VALUES = old
    assert few.keys() == many.keys() and all(math.isclose(few[k], many[k], abs_tol=1e-12) for k in few)


def test_pair_tables_are_not_shuffled_again(spark, monkeypatch):
    """Statistics lie in buckets of the pair key; a key that most tokens share does not meet in one task."""
    spec = cv.CovisSpec(targets=("t",), n_folds=2, seq_top_k=20, fold_group=("g",))
    rows = spark.range(3000).select(F.col("id").alias("rid"), (F.col("id") % 2).alias("fold"), (F.col("id") % 5 == 0).cast("int").alias("clicked"),
                                    (F.col("id") % 3).cast("string").alias("t"), (F.col("id") % 7).cast("int").alias("day_of_week"),
                                    F.concat_ws(",", F.lit("1"), (F.col("id") % 400).cast("string")).alias("seq"))
    wide = cv.stored(cv.pair_stats_wide(cv.token_rows(rows, spec, keep=["fold", "clicked"]), spec))
    plain = cv.row_features(rows, cv.pair_stats_oof_from_wide(wide, spec), spec, ["rid"], join_fold=True)
    want = {r.rid: tuple(r) for r in plain.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for heavy in (1000, 3):
            monkeypatch.setattr(cv, "HEAVY", heavy)
            got = cv.row_features_oof(rows, wide, spec, ["rid"])
            p = plan(got)
            scan = p[p.rindex("SortMergeJoin"):]
            assert "Bucketed: true" in p and scan.count("Exchange hashpartitioning") == 1, p
            for r in got.collect():
                assert tuple(r) == pytest.approx(want[r.rid], rel=1e-9)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("gating", ["softmax", "relu"])
def test_history_pool_shuffles_rows_not_tokens_or_vectors(spark, gating):
    vec = lambda i: [math.sin(i * (j + 1)) for j in range(3)]
    emb = spark.createDataFrame([(i, vec(i), 0) for i in range(60)], "vec_id long, embedding array<double>, label int")
    data = [(i // 2 if i < 6 else i, ",".join(str((i * j) % 25) if j != 2 else "x" for j in range(i % 7)) or None, i % 3) for i in range(30)]
    data += [(None, "3,4", 1), (None, None, 2)]
    rows = spark.createDataFrame(data, "rid long, seq string, inventory_id int")
    spec = hi.HistorySpec(max_len=5, top_k=3, gating=gating, query_mode="S1", dim=3, query_offset=30, rep_offset=20)
    got = hi.pool(rows, emb, spec)
    p = plan(got)
    assert len(re.findall(r"Exchange hashpartitioning\(rid", p)) == 1, p
    want, held = {}, {}
    for rid, seq, inv in data:
        toks = (seq or "").split(",")[-5:] if seq else []
        for pos, t in enumerate(toks):
            if t != "x" and rid is not None:
                score = sum(a * b for a, b in zip(vec(int(t)), vec(inv + 30))) + math.log(math.exp(-(len(toks) - 1 - pos) / 512) + 1e-8)
                held.setdefault(rid, []).append((-score, pos, int(t)))
    for rid, _, _ in data:
        top = sorted(held.get(rid, []))[:3]
        g = [math.exp(-s[0]) if gating == "softmax" else max(-s[0], 0.0) for s in top]
        z = sum(g) + (1e-12 if gating == "relu" else 0.0)
        want.setdefault(rid, []).append([len(top)] + [sum(w / z * vec(s[2] + 20)[d] for w, s in zip(g, top)) for d in range(3)])
    seen = {}
    for r in got.collect():
        seen.setdefault(r.rid, []).append([r.n_sel, *r.pooled])
    assert seen.keys() == want.keys()
    for rid, lines in want.items():
        assert len(lines) == len(seen[rid])
        for a, b in zip(lines, seen[rid]):
            assert b == pytest.approx(a, abs=1e-9), rid


@pytest.mark.parametrize("recency", ["from_start", "from_end"])
def test_row_aggregates_against_a_small_pair_table_take_no_token_apart(spark, monkeypatch, recency):
    from clickstack.operators import covisrows
    spec = cv.CovisSpec(targets=("t", "u"), n_folds=2, seq_top_k=6, fold_group=("g",), recency=recency, recency_tau=3.0, prior_strength=2.0)
    data = [(None if i % 50 == 0 else i // 2 if i < 60 else i, i % 2, int(i % 5 == 0), None if i % 11 == 0 else str(i % 3), i % 2,
             None if i % 13 == 0 else i % 7, None if i % 17 == 0 else ",".join("x" if (i + j) % 9 == 0 else str((i * j) % 12) for j in range(i % 9)))
            for i in range(300)]
    rows = spark.createDataFrame(data, "rid long, fold int, clicked int, t string, u int, day_of_week int, seq string")
    train = cv.parsed(rows, spec)
    wide = cv.stored(cv.pair_stats_wide(cv.token_rows(train, spec, keep=["fold", "clicked"]), spec))
    full = cv.pair_stats_full_from_wide(wide, spec)
    both = lambda r: [cv.row_features_oof(r, wide, spec, ["rid", "fold"]), cv.row_features(r, full, spec, ["rid"])]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = [sorted(map(tuple, df.collect()), key=lambda r: str(r[:2])) for df in both(rows)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for cells in (covisrows.CELLS, 1):
        monkeypatch.setattr(covisrows, "CELLS", cells)
        for r in (rows, train):
            for df, old in zip(both(r), want):
                assert "Generate" not in plan(df) and "Join" not in plan(df)
                got = sorted(map(tuple, df.collect()), key=lambda r: str(r[:2]))
                assert len(got) == len(old)
                for a, b in zip(got, old):
                    assert a[0] == b[0] and a[1:] == pytest.approx([x if x is not None else 0 for x in b[1:]], rel=1e-9)


def test_fits_of_a_large_table_do_not_share_the_memory(spark, monkeypatch):
    import threading
    import time
    from clickstack.operators import models as mo
    df = spark.range(40).select(F.col("id").alias("rid"), (F.col("id") % 4).alias("fold"), (F.col("id") % 2).alias("clicked"))
    now, most, lock = [0], [0], threading.Lock()

    def fit(*_, **__):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.3)
        with lock:
            now[0] -= 1

    monkeypatch.setattr(mo, "fit", fit)
    monkeypatch.setattr(mo, "score", lambda m, d, keep: d.select(*keep))
    for rows, at_once in ((40, 1), (400, 4)):
        most[0] = 0
        monkeypatch.setattr(mo, "CONCURRENT_ROWS", rows)
        mo.cross_validate(df, "clicked", "fold", 4)
        assert most[0] == at_once


@pytest.mark.parametrize("recency", ["from_start", "from_end"])
def test_pairs_are_counted_without_a_row_per_token(spark, monkeypatch, recency):
    """Nulls, junk and empty histories included; blocks of any size, dense and sparse numbers."""
    from clickstack.operators import covisrows
    spec = cv.CovisSpec(targets=("t", "u"), n_folds=2, seq_top_k=6, fold_group=("g",), recency=recency, recency_tau=3.0)
    data = [(i, i % 2, None if i % 7 == 0 else int(i % 5 == 0), None if i % 11 == 0 else str(i % 3), i % 2, None if i % 13 == 0 else i % 7,
             None if i % 17 == 0 else ",".join("x" if (i + j) % 9 == 0 else str((i * j) % 12 - 3 + 2_000_000_000 * (i % 19 == 0)) for j in range(i % 9)))
            for i in range(300)]
    rows = spark.createDataFrame(data, "rid long, fold int, clicked int, t string, u int, day_of_week int, seq string")
    asked = cv.pair_stats_wide(cv.token_rows(rows, spec, keep=["fold", "clicked"]), spec)
    order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: str(r[:4]))
    want = order(asked)
    for cells, dense in ((covisrows.CELLS, covisrows.DENSE), (1, covisrows.DENSE), (40, 1)):
        monkeypatch.setattr(covisrows, "CELLS", cells)
        monkeypatch.setattr(covisrows, "DENSE", dense)
        for r in (rows, cv.parsed(rows, spec)) if cells > 40 else (rows,):
            wide = cv.pair_stats_of_rows(r, spec)
            assert wide.dtypes == asked.dtypes and "Generate" not in plan(wide)
            got = order(wide)
            assert len(got) == len(want)
            for a, b in zip(got, want):
                assert a[:4] == b[:4] and [x is None for x in a] == [x is None for x in b]
                assert [x for x in a[4:] if x is not None] == pytest.approx([x for x in b[4:] if x is not None], rel=1e-9)


def test_only_the_kept_pieces_of_a_text_are_parsed_and_once(spark):
    spec = cv.CovisSpec(seq_top_k=3)
    texts = [None, "", ",", "1", "1,2,3", "1,2,3,4", "x,2,,4", "1,2,3,", "9,8,7,6,x", " 5 ,6"]
    rows = spark.createDataFrame([(t,) for t in texts], "seq string")
    long = rows.select("seq", F.array_join(F.split("seq", ","), ",").alias("s")).select("seq", F.regexp_replace("s", "9", "0").alias("s"))
    kept = cv.kept_tokens(long.select(F.col("s").alias("seq")), spec)
    p = plan(long.select(F.col("s").alias("seq")).select(kept))
    assert p[:p.index("Scan")].count("regexp_replace") == 1
    got = [r[0] for r in rows.select(cv.kept_tokens(rows, spec)).collect()]
    assert got == [[], [None], [None, None], [1], [1, 2, 3], [2, 3, 4], [2, None, 4], [2, 3, None], [7, 6, None], [5, 6]]


def test_a_block_is_listed_once_and_given_back(spark, tmp_path):
    from clickstack.sources import shards as sh
    df = spark.range(100).select(F.col("id").alias("rid"))
    man, block = sh.write_block(df, str(tmp_path), 30)
    assert {(r.shard, r.rows, r.start, r.end) for r in man.collect()} == {(0, 30, 0, 30), (1, 30, 30, 60), (2, 30, 60, 90), (3, 10, 90, 100)}
    assert sorted(r.rid for r in block.collect()) == list(range(100))


def test_covis_fills_are_fitted_without_the_join(spark, monkeypatch, tmp_path):
    from clickstack.operators import features as fe
    from clickstack.plans import covis_queries as cq
    seen = []
    monkeypatch.setattr(cq.fe, "fit", lambda df, *a, fit=fe.fit: (seen.append(plan(df)), fit(df, *a))[1])
    spark.range(60).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("ts"),
                           (F.col("id") % 4).alias("user_id"), F.when(F.col("id") % 3 == 0, "click").otherwise("view").alias("event_type"),
                           (F.col("id") * 1.5).alias("value"), F.format_string('{"k": %d}', F.col("id") % 9).alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    out = cq.q_features_with_covis(spark, str(tmp_path))
    assert len(seen) == 1 and "Join" not in seen[0]
    assert out.count() == 54 and out.select("rid").distinct().count() == 54


def test_rows_are_not_shuffled_for_their_folds(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 4}", i % 3) for i in range(60)], "rid long, a string, b long")
    got = folds.attach_folds(df, ["a", "b"], 3, "md5")
    p = plan(got)
    assert "BroadcastHashJoin" in p and "hashpartitioning" not in p and "SortMergeJoin" not in p
    want = {r.rid: r.fold for r in folds.group_folds(df, ["a", "b"], 3, "md5").collect()}
    assert {r.rid: r.fold for r in got.collect()} == want and len(want) == 60
