"""The streaming feature feed gives the same blocks as the batch transform."""

import tempfile

from pyspark.sql import functions as F

from clickstack.operators import features as fe
from clickstack.plans.feature_queries import SPEC
from clickstack.sources import fixtures as fx
from clickstack.streaming.feature_feed import run_feed
from conftest import SMALL


def test_feed_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="feed-", dir="/tmp")
    tr = fx.train(spark, SMALL)
    tr.repartition(3).write.parquet(f"{base}/src")
    src = spark.read.parquet(f"{base}/src")
    fitted = fe.fit(src, SPEC)
    q = run_feed(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt", fitted)
    q.awaitTermination(300)
    got = spark.read.parquet(f"{base}/out")
    exp = fe.transform(src, fitted)
    cols = ["rid", "y", "groups", "ids", "X_num", "X_mask", "X_cat", "seq"]
    a = sorted(map(tuple, got.select(*cols).collect()))
    b = sorted(map(tuple, exp.select(*cols).collect()))
    assert len(a) == tr.count() and a == b
    # a restart with the same checkpoint finds nothing new
    q2 = run_feed(spark, f"{base}/src", f"{base}/out", f"{base}/ckpt", fitted)
    q2.awaitTermination(300)
    assert spark.read.parquet(f"{base}/out").count() == len(a)
