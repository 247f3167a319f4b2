"""CTR models on tables with MLlib: class-balanced logistic regression and a
factorization machine on hashed categories + numerics + masks + covis features;
per-fold fits produce the OOF table, all fold models score the test rows, each
fold's own temperature calibrates its logits, then an ensemble combines them."""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate as ca
from . import ensemble as en


def design(df: DataFrame, cat_cols: list[str], num_cols: list[str], num_features: int = 1 << 16) -> DataFrame:
    """features = [hashed one-hot of categories (as strings, null -> 'NA'), numerics]."""
    cats = [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(f"_h_{c}") for c in cat_cols]
    d = df.select("*", *cats)
    d = FeatureHasher(inputCols=[f"_h_{c}" for c in cat_cols], outputCol="_hashed",
                      numFeatures=num_features).transform(d)
    d = VectorAssembler(inputCols=["_hashed", *num_cols], outputCol="features",
                        handleInvalid="keep").transform(d)
    return d.drop(*[f"_h_{c}" for c in cat_cols], "_hashed")


def balanced_weights(df: DataFrame, label: str, out: str = "w") -> DataFrame:
    """Class weights proportional to 0.5/n_class, scaled to mean 1."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    tot = n.select("n").scalar()
    pos = n.select("p").scalar()
    w = F.when(F.col(label) == 1, tot / (2.0 * F.greatest(pos, F.lit(1))))\
         .otherwise(tot / (2.0 * F.greatest(tot - pos, F.lit(1))))
    return df.withColumn(out, w)


def fit(df: DataFrame, label: str, kind: str = "lr", max_iter: int = 30, reg: float = 1e-3,
        factor_size: int = 8, seed: int = 777):
    """The logistic regression is class-balanced; MLlib's factorization machine takes no row
    weights, so it is fitted on the rows as they are."""
    data = balanced_weights(df, label).withColumn("_label", F.col(label).cast("double"))
    if kind == "lr":
        est = LogisticRegression(featuresCol="features", labelCol="_label", weightCol="w",
                                 maxIter=max_iter, regParam=reg)
    elif kind == "fm":
        est = FMClassifier(featuresCol="features", labelCol="_label", factorSize=factor_size,
                           maxIter=max_iter, regParam=reg, seed=seed)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return est.fit(data)


def score(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., z, p): raw logit and probability from a fitted classifier."""
    out = model.transform(df)
    raw = vector_to_array("rawPrediction")
    # both classifiers emit rawPrediction = [-margin, margin]
    return out.select(*keep, raw[1].alias("z"), vector_to_array("probability")[1].alias("p"))


def _load(kind: str, path: str):
    from pyspark.ml.classification import FMClassificationModel, LogisticRegressionModel
    return (LogisticRegressionModel if kind == "lr" else FMClassificationModel).load(path)


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


CONCURRENT_ROWS = 5_000_000  # rows that fits running at the same time may keep in memory together


def fits_at_once(rows: int, n_folds: int) -> int:
    """Every fit keeps its own rows in memory; large tables are fitted one fold after another."""
    return max(1, min(n_folds, CONCURRENT_ROWS // max(rows, 1)))


def cross_validate(df: DataFrame, label: str, fold_col: str, n_folds: int, kind: str = "lr",
                   key: str = "rid", parallelism: int | None = None, model_dir: str | None = None, **kw):
    """Fit one model per fold on the other folds; each fold's rows are scored by its
    own model.  Returns (oof DataFrame(key, fold, z, y), [models]).

    The fold fits are independent Spark jobs and are submitted concurrently from a
    small thread pool (``parallelism``, default = as many as ``fits_at_once`` allows), as MLlib's
    own tuning does; each fit is still a distributed job over the whole training part."""
    from concurrent.futures import ThreadPoolExecutor

    def one(f):
        # with model_dir, finished folds are loaded instead of refitted (resume)
        path = f"{model_dir}/fold={f}" if model_dir else None
        if path and _exists(df.sparkSession, f"{path}/metadata"):
            return _load(kind, path)
        m = fit(df.where(F.col(fold_col) != f), label, kind, **kw)
        if path:
            m.write().overwrite().save(path)
        return m
    with ThreadPoolExecutor(max_workers=parallelism or fits_at_once(df.count(), n_folds)) as pool:
        models = list(pool.map(one, range(n_folds)))
    parts = [score(m, df.where(F.col(fold_col) == f), [key, fold_col, label]) for f, m in enumerate(models)]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return oof.withColumnRenamed(label, "y"), models


def score_ensemble(test: DataFrame, models: list, oof: DataFrame, key: str = "ID",
                   method: str = "logit_mean", calibrate: bool = True, fold_col: str = "fold") -> DataFrame:
    """Every fold model scores the test rows; fold f's temperature (fitted on fold f's
    OOF logits) calibrates model f; the calibrated probabilities are ensembled."""
    wide = test.select(key, "features")
    cols = []
    # each model adds its own columns to the same rows: one scan for any number of folds
    temps = ca.fit_temperature_by(oof, "z", "y", fold_col, list(range(len(models)))) if calibrate else {}
    for f, m in enumerate(models):
        own = m.copy()
        for column in ("rawPrediction", "probability", "prediction"):
            own.set(own.getParam(f"{column}Col"), f"_{column}{f}")
        wide = own.transform(wide)
        z = vector_to_array(f"_rawPrediction{f}")[1]
        p = ca.Calibrator("temperature", T=temps[f]).proba(z) if calibrate else ca.sigmoid_stable(z)
        wide = wide.withColumn(f"p{f}", p).drop(*[f"_{c}{f}" for c in ("rawPrediction", "probability", "prediction")])
        cols.append(f"p{f}")
    out = en.combine(wide.drop("features"), cols, method, key=key, out="clicked")
    return out.select(key, "clicked")


def oof_coverage(rows: DataFrame, oof: DataFrame, key: str = "rid", fold_col: str = "fold") -> DataFrame:
    """One row: rows, rows without a score, scores given twice, scores of no row, folds."""
    mine = oof.groupBy(key).agg(F.count("z").alias("_n"), F.max(fold_col).alias("_f"))
    j = rows.select(key, F.lit(1).alias("_row")).join(mine, key, "full")
    return j.agg(F.count("_row").alias("n_rows"),
                 F.count(F.when(F.col("_row").isNotNull() & (F.coalesce("_n", F.lit(0)) == 0), 1)).alias("n_missing"),
                 F.count(F.when(F.col("_n") > 1, 1)).alias("n_dup"),
                 F.count(F.when(F.col("_row").isNull(), 1)).alias("n_stray"),
                 F.countDistinct("_f").alias("n_folds"))


def checked_oof(rows: DataFrame, oof: DataFrame, key: str = "rid", fold_col: str = "fold") -> DataFrame:
    """``oof`` if every row has exactly one score; otherwise an error that says what is wrong."""
    r = oof_coverage(rows, oof, key, fold_col).first()
    if r["n_missing"] or r["n_dup"] or r["n_stray"]:
        raise ValueError(f"out-of-fold scores do not cover the rows: {r['n_missing']} rows without one, "
                         f"{r['n_dup']} with several, {r['n_stray']} scores of unknown rows")
    return oof
