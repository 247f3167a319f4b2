"""Registered model queries (2.12, rows-only: MLlib fits are not SQL-expressible)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covis as cv
from ..operators import features as fe
from ..operators import fm
from ..operators import models as mo
from ..session import cut_lineage
from ..sources import fixtures as fx
from .covis_queries import FEATS, HASH, SPEC
from .registry import register

CATS = ["inventory_id", "day_of_week", "hour", "l_feat_14"]
NUMS = ["feat_a_1", "feat_a_1_mask"] + FEATS
HASH_FEATURES = 1 << 12  # hashed one-hot width for the fixture's four small categories


def _tables(spark, sf_dir):
    """Design matrices for train (with fold and OOF covis features) and test (with
    full-train covis features), each materialised once (checkpoint) because every
    fit iterates over it."""
    from ..operators.folds import attach_folds
    tr = cv.parsed(attach_folds(fx.train(spark, sf_dir), list(SPEC.fold_group), SPEC.n_folds, HASH), SPEC)
    te = cv.parsed(fx.test(spark, sf_dir), SPEC)
    oof, full, rf_oof, rf_test = cv.build_oof_and_test(tr, te, SPEC)
    med = fe.median_values(tr, ["feat_a_1"])["feat_a_1"]

    def numeric(df):
        miss = fe.is_missing(F.col("feat_a_1"))
        return df.withColumn("feat_a_1_mask", miss.cast("double")) \
                 .withColumn("feat_a_1", F.when(miss, med).otherwise(F.col("feat_a_1")))
    trd = cv.join_features(numeric(tr), rf_oof.drop("fold"), "rid", FEATS)
    ted = cv.join_features(numeric(te), rf_test, "ID", FEATS)
    trd = cut_lineage(mo.design(trd.select("rid", "fold", "clicked", *CATS, *NUMS), CATS, NUMS, HASH_FEATURES))
    ted = cut_lineage(mo.design(ted.select("ID", *CATS, *NUMS), CATS, NUMS, HASH_FEATURES))
    return trd, ted


@register("lr_model")
def q_lr_model(spark, sf_dir):
    """Class-balanced logistic regression on hashed categories + numerics + covis
    features; training rows with logit and probability (2.12 #2)."""
    trd, _ = _tables(spark, sf_dir)
    return mo.score(mo.fit(trd, "clicked", "lr"), trd, ["rid", "clicked"])


@register("fm_model")
def q_fm_model(spark, sf_dir):
    """Factorization machine (factor size 8) on the same design (2.12 #1)."""
    trd, _ = _tables(spark, sf_dir)
    return mo.score(mo.fit(trd, "clicked", "fm", max_iter=20), trd, ["rid", "clicked"])


@register("fm_weighted")
def q_fm_weighted(spark, sf_dir):
    """Factorization machine with class weights, fitted on whole-table gradients (2.12 #1)."""
    trd, _ = _tables(spark, sf_dir)
    n = HASH_FEATURES + len(NUMS)
    return fm.fit(mo.balanced_weights(trd, "clicked"), "clicked", "w", n, factor_size=8, max_iter=15).score(trd, ["rid", "clicked"])


@register("cv_models")
def q_cv_models(spark, sf_dir):
    """One model per fold; every training row scored by the model that did not see
    it: the OOF table (rid, fold, z, y) (2.12 #3)."""
    trd, _ = _tables(spark, sf_dir)
    oof, _ = mo.cross_validate(trd, "clicked", "fold", SPEC.n_folds, "lr")
    return oof


@register("score_ensemble")
def q_score_ensemble(spark, sf_dir):
    """Test rows scored by all fold models, calibrated per fold, logit-mean ensemble,
    as submission rows (2.12 #4)."""
    trd, ted = _tables(spark, sf_dir)
    oof, models = mo.cross_validate(trd, "clicked", "fold", SPEC.n_folds, "lr")
    oof = mo.checked_oof(trd, cut_lineage(oof))
    return mo.score_ensemble(ted, models, oof, key="ID", method="logit_mean")
