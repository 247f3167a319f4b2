"""Registered ensemble and blend queries (2.5 #3, 2.6 #5, 2.9, 2.4 #14, 2.3 #8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.prob import EPS_LOGIT, clip
from ..operators import ensemble as en
from ..operators import metrics as me
from ..sources import fixtures as fx
from . import oracle_base as ob
from .registry import register

P = ["p1", "p2", "p3", "p4"]
BASE = [ob.IMPRESSIONS, ob.MODEL_OUTPUTS,
        "moc AS (SELECT \"ID\", clicked, " + ", ".join(
            f"{ob.clip_sql(p, 1e-7, 1 - 1e-7)} AS c{i + 1}" for i, p in enumerate(P)) + " FROM mo)"]
C = ["c1", "c2", "c3", "c4"]
W = [4.0, 3.0, 2.0, 1.0]


def _ens(method, **kw):
    def q(spark, sf_dir):
        mo = fx.model_outputs(spark, sf_dir).select("ID", *P)
        return en.combine(mo, P, method, **kw).select("ID", "p")
    return q


def _reg(key, method, body, doc, **kw):
    fn = _ens(method, **kw)
    fn.__doc__ = doc
    register(key, ob.query(BASE, f'SELECT "ID", {body} AS p FROM moc', ["p"]))(fn)


_reg("ensemble_mean", "mean", "(c1 + c2 + c3 + c4) / 4.0", "Plain mean over models (2.9 #1).")
_reg("ensemble_geom_mean", "geom_mean", "exp((ln(c1) + ln(c2) + ln(c3) + ln(c4)) / 4.0)",
     "Geometric mean, clip 1e-7 (2.9 #2).")
_reg("ensemble_logit_mean", "logit_mean",
     ob.sigmoid_sql("(" + " + ".join(ob.logit_sql(c) for c in C) + ") / 4.0"),
     "Sigmoid of the mean logit (2.9 #3).")
_reg("ensemble_median", "median", "list_sort([c1, c2, c3, c4])[2]",
     "Lower median for even M, as torch.median (2.9 #4).")
_reg("ensemble_trim_mean", "trim_mean", "(list_sort([c1, c2, c3, c4])[2] + list_sort([c1, c2, c3, c4])[3]) / 2.0",
     "Trim k = round(M*0.2) = 1 lowest and highest (2.9 #5, 2.6 #5).", trim_ratio=0.2)
_reg("ensemble_weighted", "weighted", "(4 * c1 + 3 * c2 + 2 * c3 + 1 * c4) / 10.0",
     "Explicit normalised weights (2.9 #7).", weights=W)

RANK_SQL = " + ".join(f'(row_number() OVER (ORDER BY {c}, "ID")) / (count(*) OVER () + 1.0)' for c in C)
_reg("ensemble_rank_avg", "rank_avg", f"({RANK_SQL}) / 4.0",
     "Ordinal rank (r+1)/(n+1) over the whole table, averaged over models (2.5 #3, 2.9 #6, D10).")

STACK_SQL = "stk AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS model, clicked AS y, {c} AS p FROM moc" for p, c in zip(P, C)) + ")"
VW_SQL = f"""vm AS (SELECT a.model, 0.5 * a.ap + 0.5 * w.wll AS score
  FROM ({ob.ap_sql('stk', 'y', 'p', 'model')}) a JOIN ({ob.wll_sql('stk', 'y', 'p', 'model')}) w USING (model)),
vx AS (SELECT model, exp(score / 5.0 - max(score / 5.0) OVER ()) AS e FROM vm),
vw AS (SELECT model, e / sum(e) OVER () AS w FROM vx)"""


@register("ensemble_val_weighted", ob.query(
    BASE + [STACK_SQL, VW_SQL],
    'SELECT "ID", ' + " + ".join(f"(SELECT w FROM vw WHERE model = '{p}') * {c}" for p, c in zip(P, C))
    + " AS p FROM moc", ["p"]))
def q_ensemble_val_weighted(spark, sf_dir):
    """Weights = softmax(validation score / 5) over models, from a per-model metric
    table built by Spark (2.9 #8)."""
    mo = fx.model_outputs(spark, sf_dir)
    cl = mo.select("ID", "clicked", *[clip(F.col(p), EPS_LOGIT, 1 - EPS_LOGIT).alias(p) for p in P])
    stk = cl.select("clicked", F.inline(F.array(*[
        F.struct(F.lit(p).alias("model"), F.col(p).alias("p")) for p in P])))
    metrics = me.final_score(stk, "clicked", "p", by=["model"])
    wt = en.val_weights(metrics, "score", "model", temperature=5.0)
    row = wt.agg(*[F.max(F.when(F.col("model") == p, F.col("weight"))).alias(f"w_{p}") for p in P])
    terms = [F.col(f"w_{p}") * F.col(p) for p in P]
    # one row of weights for all rows: the metric plan is read once
    return cl.join(F.broadcast(row), F.lit(True)).select("ID", reduce(lambda a, b: a + b, terms).alias("p"))


@register("calibrated_ensemble", ob.query(
    BASE + [f"""cz AS (SELECT "ID", {', '.join(f'{ob.logit_sql(c)} / {t} AS z{i + 1}'
                                               for i, (c, t) in enumerate(zip(C, [0.8, 1.0, 1.25, 2.0])))} FROM moc)"""],
    'SELECT "ID", (' + " + ".join(
        ob.clip_sql(ob.sigmoid_sql(ob.clip_sql(f"z{i}", -50.0, 50.0)), 1e-7, 1 - 1e-7) for i in range(1, 5))
    + ") / 4.0 AS p FROM cz", ["p"]))
def q_calibrated_ensemble(spark, sf_dir):
    """Each model's own temperature (a per-model calibration table joined by model)
    applied to its logit before the mean (2.10 #9)."""
    from ..operators import calibrate as ca
    mo = fx.model_outputs(spark, sf_dir)
    cal = spark.createDataFrame([(p, t) for p, t in zip(P, [0.8, 1.0, 1.25, 2.0])], "model string, T double")
    return ca.calibrated_ensemble(mo, P, cal, key="ID")


# ---------------------------------------------------------------- blends of two tables
PT = [ob.IMPRESSIONS, ob.MODEL_OUTPUTS, ob.PRED_TABLES,
      'j AS (SELECT "ID", a.clicked AS clicked_1, b.clicked AS clicked_2 FROM pa a JOIN pb b USING ("ID"))']


def _tables(spark, sf_dir):
    return fx.prediction_tables(spark, sf_dir)


@register("blend_join", ob.query(PT, "SELECT * FROM j", ["clicked_1", "clicked_2"]))
def q_blend_join(spark, sf_dir):
    """One-to-one inner join of two prediction tables, duplicates refused (2.3 #8)."""
    return en.blend_join(*_tables(spark, sf_dir))


@register("blend_mean", ob.query(PT, f'SELECT "ID", {ob.clip_sql("0.6 * clicked_1 + 0.4 * clicked_2", 1e-7, 1 - 1e-7)} AS clicked FROM j', ["clicked"]))
def q_blend_mean(spark, sf_dir):
    """w * p1 + (1-w) * p2, w = 0.6 (2.9 #10)."""
    return en.blend(*_tables(spark, sf_dir), method="mean", w=0.6)


@register("blend_logit_mean", ob.query(PT, f'SELECT "ID", {ob.clip_sql(ob.sigmoid_sql("0.6 * " + ob.logit_sql("clicked_1") + " + 0.4 * " + ob.logit_sql("clicked_2")), 1e-7, 1 - 1e-7)} AS clicked FROM j', ["clicked"]))
def q_blend_logit_mean(spark, sf_dir):
    """Blend in logit space (2.9 #10)."""
    return en.blend(*_tables(spark, sf_dir), method="logit_mean", w=0.6)


def _rank_sql(c):
    return (f"((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 1)"
            f" / (count(*) OVER () - 1 + 1e-12))")


@register("blend_rank_mean", ob.query(PT, f'SELECT "ID", {ob.clip_sql("0.6 * " + _rank_sql("clicked_1") + " + 0.4 * " + _rank_sql("clicked_2"), 1e-7, 1 - 1e-7)} AS clicked FROM j', ["clicked"]))
def q_blend_rank_mean(spark, sf_dir):
    """Average-tie ranks scaled to [0,1] on the joined rows, then weighted (2.9 #10)."""
    return en.blend(*_tables(spark, sf_dir), method="rank_mean", w=0.6)


@register("blend_diagnostics", ob.query(PT, f"""SELECT corr(clicked_1, clicked_2) AS "corr", avg(clicked_1) AS mean_1,
       avg(clicked_2) AS mean_2,
       avg({ob.clip_sql(ob.sigmoid_sql("0.5 * " + ob.logit_sql("clicked_1") + " + 0.5 * " + ob.logit_sql("clicked_2")), 1e-7, 1 - 1e-7)}) AS mean_ens FROM j""",
    ["corr", "mean_1", "mean_2", "mean_ens"]))
def q_blend_diagnostics(spark, sf_dir):
    """Pearson correlation and means on the joined rows (2.4 #14, D11)."""
    return en.blend_diagnostics(*_tables(spark, sf_dir))
