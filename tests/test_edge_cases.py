"""Hand-made edge tables (FIXTURES.md section D)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickstack.functions.hashing import bucket, group_hash
from clickstack.functions.sequence import left_pad, parse_lenient, parse_strict, tail
from clickstack.operators import covis as cv
from clickstack.operators import ensemble as en
from clickstack.operators import features as fe
from clickstack.operators import metrics as me
from clickstack.sources import shards as sh

INF = float("inf")
NAN = float("nan")


def test_numeric_hygiene(spark):
    rows = [(0, 1.0, None), (1, None, None), (2, NAN, None), (3, INF, None), (4, -INF, None), (5, 3.0, None)]
    df = spark.createDataFrame(rows, "rid long, x double, allnull double")
    spec = fe.FeatureSpec(num_patterns=("x", "allnull"), label_col="y", seq_col="seq", hash_mode="md5")
    fitted = fe.fit(df, spec)
    assert fitted.num_cols == ["allnull", "x"]
    out = {r["rid"]: r for r in fe.transform(df, fitted, is_train=False, arrays=False).collect()}
    # median over {1, inf, -inf, 3, NaN}: NaN sorts last -> middle value is 3.0
    assert out[1]["x"] == pytest.approx(3.0) and out[1]["x_mask"] == 1
    assert out[2]["x"] == pytest.approx(3.0) and out[2]["x_mask"] == 1
    assert out[3]["x"] == 1e6 and out[3]["x_mask"] == 0
    assert out[4]["x"] == -1e6 and out[4]["x_mask"] == 0
    assert out[0]["x"] == 1.0
    assert all(out[i]["allnull"] == 0.0 and out[i]["allnull_mask"] == 1 for i in out)
    assert all(out[i]["y"] == 0 for i in out)  # test block: label filled with 0


def test_sequences(spark):
    seqs = [(0, None), (1, ""), (2, "5"), (3, "1,,2"), (4, "1,x,3"), (5, "7,7,7"),
            (6, ",".join(str(i) for i in range(30)))]
    df = spark.createDataFrame(seqs, "rid long, seq string")
    lenient = {r["rid"]: r["a"] for r in df.select("rid", parse_lenient(F.col("seq")).alias("a")).collect()}
    assert lenient[0] == [] and lenient[1] == [None] and lenient[3] == [1, None, 2]
    assert lenient[4] == [1, None, 3]
    t = {r["rid"]: r["a"] for r in df.select("rid", tail(parse_lenient(F.col("seq")), 4).alias("a")).collect()}
    assert t[6] == [26, 27, 28, 29] and t[2] == [5]
    ok = df.where("rid <> 4")
    pad = {r["rid"]: r["a"] for r in ok.select("rid", left_pad(parse_strict(F.col("seq")), 5, 0).alias("a")).collect()}
    assert pad[0] == [0] * 5 and pad[1] == [0] * 5 and pad[3] == [0, 0, 0, 1, 2]
    assert pad[5] == [0, 0, 7, 7, 7] and pad[6] == [25, 26, 27, 28, 29]
    with pytest.raises(Exception):
        df.where("rid = 4").select(parse_strict(F.col("seq"))).collect()


def test_null_group_and_bucket_range(spark):
    df = spark.createDataFrame([(None, 1), ("a", None), (None, None)], "g string, t int")
    r = df.select(group_hash(["g", "t"], "md5").alias("h"), bucket("g", 7, "md5").alias("b"),
                  bucket("g", 7, "xxhash").alias("bx"), F.col("g")).collect()
    assert all(0 <= x["h"] < 2147483647 for x in r)
    assert all(0 <= x["b"] < 7 and 0 <= x["bx"] < 7 for x in r)
    # null -> 'NA' before hashing
    na = spark.createDataFrame([("NA",)], "g string").select(bucket("g", 7, "md5")).first()[0]
    assert r[0]["b"] == na


def test_unseen_key_and_empty_history_give_zero_features(spark):
    spec = cv.CovisSpec(targets=("t",), time_bin=None, fold_group=("grp",))
    train = spark.createDataFrame([(0, 1, "a", "1,2", 0), (1, 0, "a", "2,3", 1), (2, 1, "b", "1", 2)],
                                  "rid long, clicked int, t string, seq string, grp int")
    test = spark.createDataFrame([("X", "a", "9"), ("Y", "zz", "1"), ("Z", "a", None)],
                                 "ID string, t string, seq string")
    tok = cv.token_rows(train, spec, keep=["clicked"])
    full = cv.pair_stats_full(tok, spec)
    rf = {r["ID"]: r for r in cv.row_features(test, full, spec, ["ID"]).collect()}
    assert set(rf) == {"X", "Y", "Z"}
    for k in ("X", "Y", "Z"):
        assert all(rf[k][c] == 0.0 for c in spec.feature_columns())


def test_d23_refused(spark):
    spec = cv.CovisSpec(targets=("inventory_id",), time_bin="day_of_week",
                        fold_group=("inventory_id", "day_of_week"))
    with pytest.raises(ValueError):
        spec.validate()
    cv.CovisSpec(targets=("inventory_id",), time_bin="day_of_week",
                 fold_group=("inventory_id", "day_of_week"), allow_empty_oof=True).validate()


def test_single_class_and_ties(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    assert me.average_precision(one, "y", "p").first()["ap"] == 0.0
    assert math.isnan(me.weighted_logloss(one, "y", "p").first()["wll"])
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)], "y int, p double")
    assert me.average_precision(tied, "y", "p").first()["ap"] == pytest.approx(0.5)


def test_duplicate_id_in_blend_refused(spark):
    a = spark.createDataFrame([("1", 0.2), ("1", 0.3)], "ID string, clicked double")
    b = spark.createDataFrame([("1", 0.4)], "ID string, clicked double")
    with pytest.raises(Exception, match="repeated ID 1"):
        en.blend(a, b, "mean").collect()


@pytest.mark.parametrize("m", [1, 2, 4])
def test_ensemble_model_counts(spark, m):
    rng = np.random.default_rng(m)
    vals = rng.uniform(0.01, 0.99, size=(20, m))
    cols = [f"p{i}" for i in range(m)]
    df = spark.createDataFrame([(str(i), *map(float, v)) for i, v in enumerate(vals)],
                               "ID string, " + ", ".join(f"{c} double" for c in cols))
    got = {r["ID"]: r["p"] for r in en.combine(df, cols, "median").collect()}
    for i, v in enumerate(vals):
        s = np.sort(v)
        assert got[str(i)] == pytest.approx(s[(m - 1) // 2])  # lower median / pass-through
    tm = {r["ID"]: r["p"] for r in en.combine(df, cols, "trim_mean", trim_ratio=0.5).collect()}
    k = en.trim_k(m, 0.5)
    assert k <= (m - 1) // 2
    for i, v in enumerate(vals):
        s = np.sort(v)
        assert tm[str(i)] == pytest.approx(s[k:m - k].mean() if m > 1 else s[0])


@pytest.mark.parametrize("n,shard_rows", [(20, 5), (23, 5), (3, 5)])
def test_manifest_tiles_rows(spark, n, shard_rows):
    df = spark.range(n).withColumnRenamed("id", "rid")
    man = sh.manifest(sh.with_shard(df, shard_rows)).orderBy("shard").collect()
    assert man[0]["start"] == 0 and man[-1]["end"] == n
    for a, b in zip(man, man[1:]):
        assert a["end"] == b["start"] and a["rows"] == shard_rows
    assert sum(r["rows"] for r in man) == n
