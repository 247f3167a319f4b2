"""Registered calibration queries (2.10, 2.7 #17, 2.1 #16, #18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prob import EPS_LOGIT, clip, sigmoid, sigmoid_stable
from ..operators import calibrate as ca
from ..operators import metrics as me
from ..operators.folds import attach_folds
from ..session import cut_lineage
from ..sources import fixtures as fx
from ..sources import shards as sh
from . import oracle_base as ob
from .registry import register

SC = [ob.IMPRESSIONS, ob.SCORES]
TEMPS = [0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
KX = [0.1, 0.3, 0.5, 0.7, 0.9]
KY = [0.05, 0.2, 0.2, 0.6, 0.95]


def _obj_sql(t: float) -> str:
    tc = min(max(t, 0.2), 5.0)
    p = ob.clip_sql(ob.sigmoid_sql(f"z / {tc}"), 1e-7, 1 - 1e-7)
    return (f"SELECT {t}::DOUBLE AS \"T\", 0.5 * (coalesce(avg(CASE WHEN clicked = 1 THEN -ln({p}) END), 0.0) + "
            f"coalesce(avg(CASE WHEN clicked <> 1 THEN -ln(1 - {p}) END), 0.0)) + {1e-3 * (tc - 1) ** 2!r} AS loss FROM scores")


@register("temperature_objective", ob.query(SC, " UNION ALL ".join(_obj_sql(t) for t in TEMPS), ["loss"]))
def q_temperature_objective(spark, sf_dir):
    """Class-balanced loss + ridge at fixed T (clamped to [0.2, 5]), one aggregation (2.10 #1)."""
    return ca.temperature_objective(fx.scores(spark, sf_dir), "z", "clicked", TEMPS)


@register("temperature_apply", ob.query(SC, 'SELECT rid, z / 5.0 AS z_t7, z / 0.5 AS z_t05 FROM scores',
                                        ["z_t7", "z_t05"]))
def q_temperature_apply(spark, sf_dir):
    """z / clamp(T, 0.2, 5) for T = 7 (clamped) and T = 0.5 (2.7 #17)."""
    s = fx.scores(spark, sf_dir)
    return s.select("rid", ca.temperature_apply("z", 7.0).alias("z_t7"),
                    ca.temperature_apply("z", 0.5).alias("z_t05"))


@register("isotonic_guard", ob.query(SC, """SELECT n_p::BIGINT AS n_distinct_p, (n_p >= 8)::INT AS iso_p,
       n_c::BIGINT AS n_distinct_coarse, (n_c >= 8)::INT AS iso_coarse
FROM (SELECT count(DISTINCT p) AS n_p, count(DISTINCT floor(p * 600 / 20)) AS n_c FROM scores)"""))
def q_isotonic_guard(spark, sf_dir):
    """Isotonic is skipped when the scores have fewer than 8 distinct values (2.10 #3)."""
    s = fx.scores(spark, sf_dir)
    g = s.agg(F.countDistinct("p").alias("n_p"),
              F.countDistinct(F.floor(F.col("p") * 600 / 20)).alias("n_c"))
    return g.select(F.col("n_p").alias("n_distinct_p"), (F.col("n_p") >= ca.MIN_ISO_NODES).cast("int").alias("iso_p"),
                    F.col("n_c").alias("n_distinct_coarse"),
                    (F.col("n_c") >= ca.MIN_ISO_NODES).cast("int").alias("iso_coarse"))


def _apply_sql(q: str) -> str:
    xs = "[" + ", ".join(map(str, KX)) + "]"
    ys = "[" + ", ".join(map(str, KY)) + "]"
    n = f"len(list_filter({xs}, lambda x: x <= {q}))"
    i = f"greatest(least({n}, {len(KX) - 1}), 1)"
    x0, x1, y0, y1 = f"{xs}[{i}]", f"{xs}[{i} + 1]", f"{ys}[{i}]", f"{ys}[{i} + 1]"
    return (f"CASE WHEN {n} = 0 THEN {KY[0]} WHEN {n} >= {len(KX)} THEN {KY[-1]} "
            f"WHEN {x1} = {x0} THEN {y1} ELSE {y0} + ({y1} - {y0}) * ({q} - {x0}) / ({x1} - {x0}) END")


@register("calibrate_apply", ob.query(
    SC + [f"ca AS (SELECT rid, {ob.clip_sql(ob.sigmoid_sql(ob.clip_sql('z / 0.5', -50.0, 50.0)), 1e-7, 1 - 1e-7)} AS q FROM scores)"],
    f"SELECT rid, {ob.clip_sql(_apply_sql('q'), 1e-7, 1 - 1e-7)} AS p FROM ca", ["p"]))
def q_calibrate_apply(spark, sf_dir):
    """predict_proba: temperature, stable sigmoid, knot interpolation, final clip (2.10 #5)."""
    cal = ca.Calibrator("temperature+isotonic", T=0.5, knots=spark.createDataFrame(list(zip(KX, KY)), "x double, y double"))
    return cal.apply(fx.scores(spark, sf_dir).select("rid", "z"), "z", "p").drop("z")


def _report_sql() -> str:
    after = ob.clip_sql(ob.sigmoid_sql(ob.clip_sql("z / 0.5", -50.0, 50.0)), 1e-7, 1 - 1e-7)
    before = ob.sigmoid_sql(ob.clip_sql("z", -50.0, 50.0))
    parts = []
    for stage, expr in (("before", before), ("after", after)):
        src = f"(SELECT clicked, {expr} AS pp FROM scores)"
        parts.append(f"""SELECT '{stage}' AS stage, ap, wll, 0.5 * ap + 0.5 * wll AS score
FROM ({ob.ap_sql(src, 'clicked', 'pp')}), ({ob.wll_sql(src, 'clicked', 'pp')})""")
    return " UNION ALL ".join(parts)


@register("calibration_report", ob.query(SC, _report_sql(), ["ap", "wll", "score"]))
def q_calibration_report(spark, sf_dir):
    """Metrics before and after calibration on the OOF logits (2.10 #7)."""
    s = fx.scores(spark, sf_dir)
    cal = ca.Calibrator("temperature", T=0.5)
    before = s.select("clicked", sigmoid_stable(F.col("z")).alias("pp"))
    after = s.select("clicked", cal.proba(F.col("z")).alias("pp"))
    b = me.final_score(before, "clicked", "pp").select(F.lit("before").alias("stage"), "ap", "wll", "score")
    a = me.final_score(after, "clicked", "pp").select(F.lit("after").alias("stage"), "ap", "wll", "score")
    return b.unionByName(a)


@register("oof_check", ob.query(
    [ob.IMPRESSIONS, ob.TRAIN, ob.folds_cte()],
    """SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS n_missing, 0::BIGINT AS n_dup, 0::BIGINT AS n_stray,
       count(DISTINCT fold)::BIGINT AS n_folds FROM trainf"""))
def q_oof_check(spark, sf_dir):
    """Out-of-fold scores of real fold models against the training rows: each has exactly one
    (2.1 #18, 2.10 #8)."""
    from ..operators import models as mo
    tr = attach_folds(fx.train(spark, sf_dir), ["inventory_id", "day_of_week"], 5, "md5")
    d = cut_lineage(mo.design(tr.select("rid", "fold", "clicked", "inventory_id", "hour", "k"), ["inventory_id", "hour"], ["k"], 256))
    oof, _ = mo.cross_validate(d, "clicked", "fold", 5, "lr", max_iter=5)
    return mo.oof_coverage(tr, oof)


# ---------------------------------------------------------------- fits
def _fit_sql(src: str, z: str = "z", rounds: int = 5, points: int = 17, name: str = "t") -> list[str]:
    """CTEs of the same grid search; ``{name}_best`` holds T and loss."""
    n = points - 1
    ctes = [f"{name}_b0 AS (SELECT ln(0.2) AS lo, ln(5.0) AS hi)"]
    for i in range(rounds):
        p = ob.clip_sql(ob.sigmoid_sql(f"{z} / t"), 1e-7, 1 - 1e-7)
        ctes += [
            f"{name}_g{i} AS (SELECT r.range AS k, exp(lo + (hi - lo) * r.range / {n}) AS t, lo, hi FROM {name}_b{i}, range({points}) r)",
            f"""{name}_l{i} AS (SELECT k, t, lo, hi, 0.5 * (coalesce(avg(CASE WHEN clicked = 1 THEN -ln({p}) END), 0.0)
                + coalesce(avg(CASE WHEN clicked <> 1 THEN -ln(1 - {p}) END), 0.0)) + 1e-3 * (t - 1) * (t - 1) AS loss
                FROM {name}_g{i}, {src} GROUP BY k, t, lo, hi)""",
            f"{name}_m{i} AS (SELECT * FROM {name}_l{i} ORDER BY loss, k LIMIT 1)",
            f"""{name}_b{i + 1} AS (SELECT greatest(ln(0.2), ln(t) - (hi - lo) / {n}) AS lo,
                least(ln(5.0), ln(t) + (hi - lo) / {n}) AS hi FROM {name}_m{i})"""]
    best = " UNION ALL ".join(f"SELECT {i} AS i, t, loss FROM {name}_m{i}" for i in range(rounds))
    return ctes + [f"{name}_best AS (SELECT t AS \"T\", loss FROM ({best}) ORDER BY loss, i LIMIT 1)"]


def _iso_sql(src: str) -> list[str]:
    """CTEs of the isotonic fit of clicked on pz in its max-min form: the value at i is the
    greatest, over starts j <= i, of the least mean of j..k over ends k >= i."""
    return [f"""iw AS (SELECT pz AS x, sum(CASE WHEN clicked = 1 THEN 0.5 / np ELSE 0.5 / nn END) AS w,
       sum(CASE WHEN clicked = 1 THEN 0.5 / np ELSE 0 END) AS wy
FROM {src}, (SELECT sum(clicked) AS np, sum(1 - clicked) AS nn FROM {src}) GROUP BY pz)""",
            """ic AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw,
       sum(wy) OVER (ORDER BY x) AS cy, w, wy FROM iw)""",
            """ig AS (SELECT a.i AS j, b.i, min((b.cy - a.cy + a.wy) / (b.cw - a.cw + a.w)) OVER (
       PARTITION BY a.i ORDER BY b.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM ic a JOIN ic b ON a.i <= b.i)""",
            """iv AS (SELECT ic.x, round(max(g), 9) AS y FROM ig JOIN ic USING (i) GROUP BY ic.x),
ik AS (SELECT y, min(x) AS x0, max(x) AS x1 FROM iv GROUP BY y),
knots AS (SELECT x0 AS x, y FROM ik UNION SELECT x1, y FROM ik)"""]


STEPS = 'zs AS (SELECT clicked, floor(z * 40) / 40 AS z FROM scores)'


def _stepped(spark, sf_dir):
    """The informative logit in steps of 1/40: scores with ties."""
    return fx.scores(spark, sf_dir).select("clicked", (F.floor(F.col("z") * 40) / 40).alias("z"))


@register("temperature_fit", ob.query(SC + _fit_sql("scores"), "SELECT * FROM t_best", ['"T"', "loss"]))
def q_temperature_fit(spark, sf_dir):
    """T minimising the class-balanced loss + 1e-3 (T-1)^2 on the informative logit (2.10 #1)."""
    t, loss = ca.fit_temperature(fx.scores(spark, sf_dir), "z", "clicked")
    return spark.range(1).select(F.lit(t).alias("T"), F.lit(loss).alias("loss"))


@register("isotonic_fit", ob.query(SC + [STEPS, f"iz AS (SELECT clicked, {ob.sigmoid_sql('z')} AS pz FROM zs)"] + _iso_sql("iz"),
                                   "SELECT * FROM knots", ["x", "y"]))
def q_isotonic_fit(spark, sf_dir):
    """Isotonic knots on sigmoid(z) with 50:50 class weights (2.10 #2)."""
    s = _stepped(spark, sf_dir).withColumn("pz", sigmoid_stable(F.col("z")))
    return ca.isotonic_knots(s, "pz", "clicked")


@register("temp_isotonic", ob.query(
    SC + [STEPS] + _fit_sql("zs") + [f"""iz AS (SELECT clicked, {ob.sigmoid_sql('z / least(greatest("T", 0.2), 5.0)')} AS pz FROM zs, t_best)"""]
    + _iso_sql("iz"), 'SELECT x, y, "T" FROM knots, t_best', ["x", "y", '"T"']))
def q_temp_isotonic(spark, sf_dir):
    """Temperature, then isotonic on the tempered probabilities (2.10 #4)."""
    cal = ca.fit(_stepped(spark, sf_dir), "z", "clicked", "temperature+isotonic")
    return cal.knots.withColumn("T", F.lit(cal.T))


def _meta_sql() -> list[str]:
    """CTEs of the calibrated probabilities: as-of segments of the knots, before and after metrics."""
    before = ob.sigmoid_sql(ob.clip_sql("z", -50.0, 50.0))
    q = ob.clip_sql(ob.sigmoid_sql(ob.clip_sql('z / least(greatest("T", 0.2), 5.0)', -50.0, 50.0)), 1e-7, 1 - 1e-7)
    value = "coalesce(a.y + (b.y - a.y) * (q - a.x) / (b.x - a.x), a.y, b.y)"
    ctes = [f"mq AS (SELECT clicked, {before} AS p0, {q} AS q FROM zs, t_best)",
            f"""mp AS (SELECT clicked, p0, {ob.clip_sql(value, 1e-7, 1 - 1e-7)} AS p1 FROM mq
    ASOF LEFT JOIN knots a ON mq.q >= a.x ASOF LEFT JOIN knots b ON mq.q < b.x)"""]
    for i, stage in enumerate(("before", "after")):
        src = f"(SELECT clicked, p{i} AS pp FROM mp)"
        ctes.append(f"""m_{stage} AS (SELECT ap AS ap_{stage}, wll AS wll_{stage}, 0.5 * ap + 0.5 * wll AS score_{stage}
FROM ({ob.ap_sql(src, 'clicked', 'pp')}), ({ob.wll_sql(src, 'clicked', 'pp')}))""")
    return ctes


META = ["method", "T", "clamp_lo", "clamp_hi", "l2", "min_iso_nodes", "isotonic_skipped",
        "ap_before", "wll_before", "score_before", "ap_after", "wll_after", "score_after"]


@register("calibration_meta", ob.query(
    SC + [STEPS] + _fit_sql("zs") + [f"""iz AS (SELECT clicked, {ob.sigmoid_sql('z / least(greatest("T", 0.2), 5.0)')} AS pz FROM zs, t_best)"""]
    + _iso_sql("iz") + _meta_sql(), f"""SELECT 'temperature+isotonic' AS method, "T", {ca.T_CLAMP[0]}::DOUBLE AS clamp_lo, {ca.T_CLAMP[1]}::DOUBLE AS clamp_hi,
       {ca.L2_REG}::DOUBLE AS l2, {ca.MIN_ISO_NODES}::BIGINT AS min_iso_nodes, false AS isotonic_skipped, ap_before, wll_before, score_before,
       ap_after, wll_after, score_after, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM t_best, m_before, m_after
UNION ALL SELECT {', '.join('NULL' for _ in META)}, x, y FROM knots""",
    ['"T"', "ap_before", "wll_before", "score_before", "ap_after", "wll_after", "score_after", "x", "y"]))
def q_calibration_meta(spark, sf_dir):
    """Calibration metadata written as JSON to the shared folder and read back (2.1 #16): one record
    with the settings and the before/after metrics, and one record per isotonic knot."""
    s = _stepped(spark, sf_dir)
    cal = ca.fit(s, "z", "clicked", "temperature+isotonic")
    before = me.final_score(s.select("clicked", sigmoid_stable(F.col("z")).alias("pp")), "clicked", "pp").first()
    after = me.final_score(cal.apply(s, "z", "pp"), "clicked", "pp").first()
    scores = [F.lit(r[c]).alias(f"{c}_{stage}") for stage, r in (("before", before), ("after", after)) for c in ("ap", "wll", "score")]
    meta = spark.range(1).select(
        F.lit(cal.method).alias("method"), F.lit(cal.T).alias("T"),
        F.lit(ca.T_CLAMP[0]).alias("clamp_lo"), F.lit(ca.T_CLAMP[1]).alias("clamp_hi"),
        F.lit(ca.L2_REG).alias("l2"), F.lit(ca.MIN_ISO_NODES).cast("long").alias("min_iso_nodes"),
        F.lit(cal.isotonic_skipped).alias("isotonic_skipped"), *scores)
    both = meta.unionByName(cal.knots, allowMissingColumns=True) if cal.knots is not None else meta
    path = sh.scratch_path(spark, "calib-meta")
    both.write.mode("overwrite").json(path)
    return spark.read.schema(both.schema).json(path)
