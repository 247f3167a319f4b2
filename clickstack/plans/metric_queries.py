"""Registered metric queries (2.4 #10-16, 2.5 #2, #6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prob import sigmoid
from ..operators import metrics as me
from ..operators.folds import attach_folds
from ..sources import fixtures as fx
from . import oracle_base as ob
from .registry import register

SC = [ob.IMPRESSIONS, ob.SCORES]
SCZ = SC + [f"sz AS (SELECT *, {ob.sigmoid_sql('z')} AS pz FROM scores)"]


@register("wll", ob.query(SC, ob.wll_sql("scores", "clicked", "p"), ["wll"]))
def q_wll(spark, sf_dir):
    """50:50 log-loss of the tied probability column (2.4 #10, 2.7 #14)."""
    return me.weighted_logloss(fx.scores(spark, sf_dir), "clicked", "p")


@register("wll_from_logits", ob.query(SC, """SELECT 0.5 * (coalesce(lp, 0.0) + coalesce(ln, 0.0)) AS wll FROM (
  SELECT avg(CASE WHEN clicked > 0.5 THEN ln(1 + exp(-abs(-z))) + greatest(-z, 0) END) AS lp,
         avg(CASE WHEN NOT (clicked > 0.5) THEN ln(1 + exp(-abs(z))) + greatest(z, 0) END) AS ln FROM scores)""",
    ["wll"]))
def q_wll_from_logits(spark, sf_dir):
    """Same loss from logits through a stable softplus (2.4 #11)."""
    return me.wll_from_logits(fx.scores(spark, sf_dir), "clicked", "z")


@register("average_precision", ob.query(
    SCZ, f"""SELECT (SELECT ap FROM ({ob.ap_sql('sz', 'clicked', 'p')})) AS ap_p,
       (SELECT ap FROM ({ob.ap_sql('sz', 'clicked', 'pz')})) AS ap_z""", ["ap_p", "ap_z"]))
def q_average_precision(spark, sf_dir):
    """AP of a heavily tied score and of sigmoid(z) (2.4 #12, 2.5 #6)."""
    s = fx.scores(spark, sf_dir).withColumn("pz", sigmoid(F.col("z")))
    a = me.average_precision(s, "clicked", "p").select("ap").scalar()
    b = me.average_precision(s, "clicked", "pz").select("ap").scalar()
    return spark.range(1).select(a.alias("ap_p"), b.alias("ap_z"))


@register("final_score", ob.query(
    SCZ, f"""SELECT ap, wll, 0.5 * ap + 0.5 * wll AS score FROM ({ob.ap_sql('sz', 'clicked', 'pz')}),
    ({ob.wll_sql('sz', 'clicked', 'pz')})""", ["ap", "wll", "score"]))
def q_final_score(spark, sf_dir):
    """0.5*AP + 0.5*WLL as coded in the reference (2.4 #13, D9)."""
    s = fx.scores(spark, sf_dir).withColumn("pz", sigmoid(F.col("z")))
    return me.final_score(s, "clicked", "pz")


FOLD_SC = SCZ + [ob.folds_cte("sz", name="szf")]


@register("fold_metrics", ob.query(
    FOLD_SC, f"""SELECT a.fold, 'valid' AS split, n.n_rows, a.ap, w.wll, 0.5 * a.ap + 0.5 * w.wll AS score
FROM ({ob.ap_sql('szf', 'clicked', 'p', 'fold')}) a JOIN ({ob.wll_sql('szf', 'clicked', 'p', 'fold')}) w USING (fold)
JOIN (SELECT fold, count(*)::BIGINT AS n_rows FROM szf GROUP BY fold) n USING (fold)""", ["ap", "wll", "score"]))
def q_fold_metrics(spark, sf_dir):
    """Per-fold validation metrics table, appended per run (2.1 #17, 2.4 #13)."""
    s = fx.scores(spark, sf_dir).withColumn("pz", sigmoid(F.col("z")))
    s = attach_folds(s, ["inventory_id", "day_of_week"], 5, "md5")
    # p is an exact ratio, so its ties are the same in every engine (sigmoid outputs can
    # differ in the last bit between engines and split or merge near-ties)
    m = me.final_score(s, "clicked", "p", by=["fold"])
    n = s.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))
    return m.join(n, "fold").select("fold", F.lit("valid").alias("split"), "n_rows", "ap", "wll", "score")


@register("class_weights", ob.query([ob.IMPRESSIONS, ob.TRAIN], """SELECT n_pos, n_neg, 0.5 / n_pos AS w_pos, 0.5 / n_neg AS w_neg
FROM (SELECT greatest(sum((clicked = 1)::INT), 1)::BIGINT AS n_pos, greatest(sum((clicked = 0)::INT), 1)::BIGINT AS n_neg FROM train)""",
    ["w_pos", "w_neg"]))
def q_class_weights(spark, sf_dir):
    """Class-balance weights 0.5/n_pos and 0.5/n_neg, counts floored at 1 (2.4 #15)."""
    return me.class_weights(fx.train(spark, sf_dir), "clicked")


@register("logit_l2", ob.query(SC, "SELECT avg(z * z) AS logit_l2 FROM scores", ["logit_l2"]))
def q_logit_l2(spark, sf_dir):
    """Mean squared logit (2.4 #16)."""
    return me.logit_l2(fx.scores(spark, sf_dir), "z")


@register("rank_scaled", ob.query(
    [ob.IMPRESSIONS, ob.MODEL_OUTPUTS, ob.PRED_TABLES],
    """SELECT "ID", (rank() OVER (ORDER BY clicked) + (count(*) OVER (PARTITION BY clicked) - 1) / 2.0 - 1)
              / (count(*) OVER () - 1 + 1e-12) AS r FROM pa""", ["r"]))
def q_rank_scaled(spark, sf_dir):
    """Average-tie rank scaled to [0,1] over the whole table (2.5 #2)."""
    a, _ = fx.prediction_tables(spark, sf_dir)
    n = a.agg(F.count(F.lit(1))).scalar()
    r = me.tie_average_rank(a, "clicked", out="_r")
    return r.select("ID", ((F.col("_r") - 1) / ((n - 1).cast("double") + F.lit(1e-12))).alias("r"))


@register("logit_sigmoid", ob.query(SC, f"""SELECT rid, {ob.logit_sql('p')} AS logit_p, {ob.sigmoid_sql('z')} AS sigmoid_z,
       {ob.sigmoid_sql(ob.clip_sql('z * 40', -50.0, 50.0))} AS sigmoid_stable_z40 FROM scores""",
    ["logit_p", "sigmoid_z", "sigmoid_stable_z40"]))
def q_logit_sigmoid(spark, sf_dir):
    """Logit with clip 1e-7, sigmoid, and the stable sigmoid clipped to +-50 (2.7 #13)."""
    from ..functions.prob import logit, sigmoid_stable
    s = fx.scores(spark, sf_dir)
    return s.select("rid", logit(F.col("p")).alias("logit_p"), sigmoid(F.col("z")).alias("sigmoid_z"),
                    sigmoid_stable(F.col("z") * 40).alias("sigmoid_stable_z40"))
