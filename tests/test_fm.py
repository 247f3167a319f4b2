import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from clickstack.operators import fm
from clickstack.operators import metrics as me
from clickstack.operators import models as mo


def sparse(rng, rows=40, n=12):
    start = np.concatenate([[0], np.cumsum(rng.integers(0, 5, rows))])
    return start, rng.integers(0, n, start[-1]), rng.normal(size=start[-1]), rng.integers(0, 2, rows) * 1.0, rng.random(rows) + 0.1


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    for k in (0, 1, 3):
        data, theta = sparse(rng), rng.normal(scale=0.5, size=1 + 12 * (1 + k))
        _, g = fm.gradient(theta, 12, *data)
        for j in range(len(theta)):
            e = np.zeros(len(theta))
            e[j] = 1e-6
            slope = (fm.gradient(theta + e, 12, *data)[0] - fm.gradient(theta - e, 12, *data)[0]) / 2e-6
            assert slope == pytest.approx(g[j], abs=1e-4)


def table(spark, n=600):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        a, b = int(rng.integers(0, 6)), int(rng.integers(6, 12))
        y = int(rng.random() < (0.9 if (a + b) % 3 == 0 else 0.05))
        rows.append((i, y, Vectors.sparse(12, {a: 1.0, b: 1.0}) if i % 2 else Vectors.dense([float(j in (a, b)) for j in range(12)])))
    return mo.balanced_weights(spark.createDataFrame(rows, ["rid", "y", "features"]), "y").cache()


def test_table_gradient_equals_one_pass(spark, monkeypatch):
    monkeypatch.setattr(fm, "BLOCK", 7)
    df = table(spark)
    rows = fm.sparse_rows(df, [F.col("y").cast("double").alias("y"), F.col("w").alias("weight")])
    theta = np.random.default_rng(3).normal(size=1 + 12 * 3)
    got = rows.collect()
    start = np.concatenate([[0], np.cumsum([len(r._i) for r in got])])
    want = fm.gradient(theta, 12, start, np.concatenate([r._i for r in got]), np.concatenate([r._x for r in got]),
                       np.array([r.y for r in got]), np.array([r.weight for r in got]))
    loss, g = fm.table_gradient(rows.repartition(5), theta, 12)
    assert loss == pytest.approx(want[0]) and g == pytest.approx(want[1])


def test_weighted_fit_learns_and_resumes(spark, tmp_path):
    df = table(spark)
    model = fm.fit(df, "y", "w", 12, factor_size=4, max_iter=12, model_dir=str(tmp_path / "m"))
    assert model.losses[-1] < model.losses[0] * 0.9
    short = fm.fit(df, "y", "w", 12, factor_size=4, max_iter=5, model_dir=str(tmp_path / "n"))
    again = fm.fit(df, "y", "w", 12, factor_size=4, max_iter=12, model_dir=str(tmp_path / "n"))
    assert len(short.losses) == 5 and again.theta == pytest.approx(model.theta) and again.losses == pytest.approx(model.losses)
    out = model.score(df, ["rid", "y"])
    assert out.count() == 600 and out.where("p < 0 or p > 1").isEmpty()
    ap = me.average_precision(out, "y", "p").first()["ap"]
    plain = fm.fit(df.withColumn("one", F.lit(1.0)), "y", "one", 12, factor_size=4, max_iter=12).score(df, ["rid", "y"])
    assert ap > 0.5 and abs(ap - me.average_precision(plain, "y", "p").first()["ap"]) < 0.2
    # class weights move the mean prediction to one half
    assert 0.35 < out.agg(F.avg("p")).first()[0] and plain.agg(F.avg("p")).first()[0] < out.agg(F.avg("p")).first()[0]


def test_steps_read_written_rows_not_the_plan(spark, monkeypatch):
    """The weights and vectors are worked out once, whatever the number of steps."""
    seen = []
    real = fm.table_gradient
    monkeypatch.setattr(fm, "table_gradient", lambda rows, *a: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), real(rows, *a))[1])
    fm.fit(table(spark).unpersist(), "y", "w", 12, factor_size=2, max_iter=2)
    assert len(seen) == 2 and all("FileScan parquet" in p and "unwrap_udt" not in p and "Subquery" not in p for p in seen)
