"""Sinks and resumable per-fold training."""

import tempfile

from pyspark.sql import functions as F

from clickstack.operators import calibrate as ca
from clickstack.operators import covis as cv
from clickstack.operators import models as mo
from clickstack.operators.folds import attach_folds
from clickstack.plans.covis_queries import SPEC
from clickstack.sources import fixtures as fx
from clickstack.sources import tables as tb
from conftest import SMALL


def test_covis_sinks_partitioned(spark):
    tr = attach_folds(fx.train(spark, SMALL), list(SPEC.fold_group), 5, "md5")
    out = tempfile.mkdtemp(prefix="covis-", dir="/tmp")
    outs = cv.build_oof_and_test(tr, fx.test(spark, SMALL), SPEC)
    cv.write_outputs(*outs, out)
    back = spark.read.parquet(f"{out}/pair_oof")
    assert back.where((F.col("target") == "l_feat_14") & (F.col("fold") == 2)).count() == \
        outs[0].where(F.col("fold") == 2).count()
    assert spark.read.parquet(f"{out}/rowfeat_oof").count() == tr.count()
    m = spark.createDataFrame([(0, "valid", 0.5)], "fold int, split string, ap double")
    tb.append_metrics(m, f"{out}/log")
    tb.append_metrics(m, f"{out}/log")
    assert spark.read.parquet(f"{out}/log").count() == 2


def test_cross_validate_resumes(spark):
    rows = fx.train(spark, SMALL).select("rid", "clicked", (F.col("rid") % 3).cast("int").alias("fold"),
                                          F.col("k").cast("double").alias("k"), "inventory_id")
    d = mo.design(rows, ["inventory_id"], ["k"], 64)
    md = tempfile.mkdtemp(prefix="models-", dir="/tmp")
    oof1, _ = mo.cross_validate(d, "clicked", "fold", 3, "lr", model_dir=md, max_iter=5)
    oof2, _ = mo.cross_validate(d, "clicked", "fold", 3, "lr", model_dir=md, max_iter=50)  # loaded, not refitted
    a = sorted(map(tuple, oof1.select("rid", "z").collect()))
    b = sorted(map(tuple, oof2.select("rid", "z").collect()))
    assert a == b and len(a) == rows.count()


def test_older_calibration_variant(spark):
    s = fx.scores(spark, SMALL)
    cal = ca.fit(s, "z", "clicked", "isotonic", balanced=False, min_nodes=0, clamp=None)
    ys = [r.y for r in cal.knots.orderBy("x").collect()]
    assert ys and ys == sorted(ys)
