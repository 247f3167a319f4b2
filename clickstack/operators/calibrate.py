"""Calibration: temperature scaling (class-balanced loss + ridge), isotonic regression
with 50:50 weights, and applying them.

The temperature fit evaluates a grid of candidate T as columns of ONE aggregation per
round (5 rounds x 17 candidates), refining around the best; the data is scanned once
per round and nothing but 17 numbers reaches the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prob import EPS_LOGIT, clip, sigmoid, sigmoid_stable
from ..session import cut_lineage
from . import metrics as me
from .asof import between_marks
from .isotonic import pools

# Reference calibration defaults.
T_CLAMP = (0.2, 5.0)
L2_REG = 1e-3
MIN_ISO_NODES = 8


def temperature_apply(z, t: float, clamp: tuple | None = T_CLAMP) -> Column:
    tc = min(max(t, clamp[0]), clamp[1]) if clamp else t
    zc = F.col(z) if isinstance(z, str) else z
    return zc / F.lit(float(tc))


def _loss_at(z: Column, y: Column, t: float, l2: float) -> tuple[Column, Column]:
    p = clip(sigmoid(z / F.lit(float(t))), EPS_LOGIT, 1 - EPS_LOGIT)
    return F.avg(F.when(y == 1, -F.ln(p))), F.avg(F.when(y != 1, -F.ln(F.lit(1.0) - p)))


def temperature_objective(df: DataFrame, z: str, y: str, temps: list[float], l2: float = L2_REG,
                          clamp: tuple | None = T_CLAMP) -> DataFrame:
    """Loss 0.5*(mean_pos + mean_neg) + l2*(T-1)^2 for each T, one aggregation."""
    zc, yc = F.col(z).cast("double"), F.col(y)
    aggs, tcs = [], []
    for i, t in enumerate(temps):
        tc = min(max(t, clamp[0]), clamp[1]) if clamp else t
        tcs.append(tc)
        lp, ln = _loss_at(zc, yc, tc, l2)
        aggs += [lp.alias(f"lp{i}"), ln.alias(f"ln{i}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(float(t)).alias("T"),
                      (0.5 * (F.coalesce(F.col(f"lp{i}"), F.lit(0.0)) + F.coalesce(F.col(f"ln{i}"), F.lit(0.0)))
                       + F.lit(l2 * (tc - 1.0) ** 2)).alias("loss"))
             for i, (t, tc) in enumerate(zip(temps, tcs))]
    return row.select(F.inline(F.array(*parts)))


def _losses_by(df: DataFrame, z: str, y: str, by: str, grids: dict, l2: float) -> dict:
    """Losses of each group's own candidates, from ONE aggregation grouped by ``by``."""
    points = len(next(iter(grids.values())))
    aggs = []
    for i in range(points):
        t = F.lit(None).cast("double")  # the candidate of point i differs per group
        for g, grid in grids.items():
            t = F.when(F.col(by) == g, F.lit(grid[i])).otherwise(t)
        p = clip(sigmoid(F.col(z) / t), EPS_LOGIT, 1 - EPS_LOGIT)
        aggs += [F.avg(F.when(F.col(y) == 1, -F.ln(p))).alias(f"lp{i}"), F.avg(F.when(F.col(y) != 1, -F.ln(F.lit(1.0) - p))).alias(f"ln{i}")]
    rows = [r for r in df.groupBy(by).agg(*aggs).collect() if r[by] in grids]  # one row per group
    return {r[by]: [0.5 * ((r[f"lp{i}"] or 0.0) + (r[f"ln{i}"] or 0.0)) + l2 * (grids[r[by]][i] - 1.0) ** 2 for i in range(points)] for r in rows}


def fit_temperature_by(df: DataFrame, z: str, y: str, by: str, groups: list, l2: float = L2_REG,
                       clamp: tuple | None = T_CLAMP, rounds: int = 5, points: int = 17) -> dict:
    """One temperature per group (e.g. per fold): every round is ONE aggregation
    grouped by ``by`` with the candidate grid of each group as columns.  Without a clamp a group's
    search starts on [1e-3, 1e3] and widens while its best T lies at an end; a group without rows
    keeps T = 1."""
    df = cut_lineage(df.where(F.col(by).isin(list(groups)))
                     .select(F.col(by), F.col(z).cast("double").alias(z), F.col(y)), "tfit")
    start = (math.log(clamp[0]), math.log(clamp[1])) if clamp else (math.log(1e-3), math.log(1e3))
    ends = start if clamp else (-600.0, 600.0)
    span = {g: start for g in groups}

    def grids(of):
        return {g: [math.exp(span[g][0] + (span[g][1] - span[g][0]) * i / (points - 1)) for i in range(points)] for g in of}

    wide = [] if clamp else list(groups)
    while wide:
        losses = _losses_by(df, z, y, by, grids(wide), l2)
        before = dict(span)
        for g, v in losses.items():
            (lo, hi), least = span[g], min(v)  # saturated scores can tie over a whole side
            span[g] = (max(ends[0], 2 * lo - hi) if v[0] == least else lo, min(ends[1], 2 * hi - lo) if v[-1] == least else hi)
        wide = [g for g in losses if span[g] != before[g]]
    best = {g: (1.0, float("inf")) for g in groups}
    for _ in range(rounds):
        at = grids(groups)
        for g, v in _losses_by(df, z, y, by, at, l2).items():
            i = min(range(points), key=lambda k: (v[k], k))
            if v[i] < best[g][1]:
                best[g] = (at[g][i], v[i])
            step, c = (span[g][1] - span[g][0]) / (points - 1), math.log(at[g][i])
            span[g] = (max(ends[0], c - step), min(ends[1], c + step))
    return {g: best[g][0] for g in groups}


def fit_temperature(df: DataFrame, z: str, y: str, l2: float = L2_REG, clamp: tuple | None = T_CLAMP,
                    rounds: int = 5, points: int = 17) -> tuple[float, float]:
    """argmin over T in [clamp] of the objective; returns (T, loss).  Without a clamp the
    search starts on [1e-3, 1e3] and widens while the best T lies at an end.

    The (z, y) columns are materialised once (shared folder) since every round scans
    them."""
    df = cut_lineage(df.select(F.col(z).cast("double").alias(z), F.col(y)), "tfit")
    lo, hi = (math.log(clamp[0]), math.log(clamp[1])) if clamp else (math.log(1e-3), math.log(1e3))
    best_t, best_loss = 1.0, float("inf")
    ends = (lo, hi) if clamp else (-600.0, 600.0)
    while not clamp:
        grid = [math.exp(lo + (hi - lo) * i / (points - 1)) for i in range(points)]
        losses = [r["loss"] for r in temperature_objective(df, z, y, grid, l2, None).collect()]  # `points` rows
        wide, least = hi - lo, min(losses)  # saturated scores can tie over a whole side
        new = (max(ends[0], lo - wide) if losses[0] == least else lo, min(ends[1], hi + wide) if losses[-1] == least else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    for _ in range(rounds):
        grid = [math.exp(lo + (hi - lo) * i / (points - 1)) for i in range(points)]
        rows = temperature_objective(df, z, y, grid, l2, clamp).collect()  # `points` rows
        losses = [r["loss"] for r in rows]
        i = min(range(points), key=lambda k: (losses[k], k))
        if losses[i] < best_loss:
            best_t, best_loss = grid[i], losses[i]
        step = (hi - lo) / (points - 1)
        lo = max(ends[0], math.log(grid[i]) - step)
        hi = min(ends[1], math.log(grid[i]) + step)
    return best_t, best_loss


@dataclass
class Calibrator:
    method: str = "temperature"  # temperature | isotonic | temperature+isotonic
    T: float | None = None
    knots: DataFrame | None = None  # (x, y); they stay a table
    clamp: tuple | None = T_CLAMP

    # True where an isotonic step was asked for and the scores had too few distinct values
    isotonic_skipped: bool = False

    def logits(self, z: Column) -> Column:
        return temperature_apply(z, float(self.T), self.clamp) if self.T is not None else z

    def proba(self, z: Column) -> Column:
        """Calibrated probability as an expression, for a calibrator without knots."""
        if self.knots is not None:
            raise ValueError("knots are applied to a table, see Calibrator.apply")
        return clip(sigmoid_stable(self.logits(z)), EPS_LOGIT, 1 - EPS_LOGIT)

    def apply(self, df: DataFrame, z: str, out: str = "p") -> DataFrame:
        """``df`` with the calibrated probability of the logit ``z``."""
        p = clip(sigmoid_stable(self.logits(F.col(z))), EPS_LOGIT, 1 - EPS_LOGIT)
        df = df.withColumn(out, p)
        if self.knots is None:
            return df
        return interpolate(df, out, self.knots, out).withColumn(out, clip(F.col(out), EPS_LOGIT, 1 - EPS_LOGIT))


def isotonic_knots(df: DataFrame, p: str, y: str, min_nodes: int = MIN_ISO_NODES,
                   balanced: bool = True) -> DataFrame | None:
    """Isotonic fit of y on p with class-balanced weights, by merged convex minorants (see
    ``isotonic``).  Returns the knot table (x, y), the ends of every pool, or None when p has fewer
    than ``min_nodes`` distinct values.  ``balanced=False, min_nodes=0`` is the older unweighted,
    unguarded variant."""
    # equal scores are one point: the fit is the same on far fewer rows
    one = F.col(y) == 1
    data = cut_lineage(df.select(F.col(p).cast("double").alias("p"), one.alias("one")).where(F.col("p").isNotNull())
                       .groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("one"), 1).otherwise(0)).alias("pos")), "scores")
    if min_nodes > 0 and data.count() < min_nodes:
        return None
    w_pos = w_neg = F.lit(1.0)
    if balanced:
        w = me.class_weights(df, y).first()
        w_pos, w_neg = F.lit(w["w_pos"]), F.lit(w["w_neg"])
    got = pools(data, "p", "n", "pos")
    positive, negative = F.col("pos") * w_pos, (F.col("n") - F.col("pos")) * w_neg
    return cut_lineage(got.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), (positive / (positive + negative)).alias("y")), "knots")


def interpolate(df: DataFrame, p: str, knots: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: piecewise-linear interpolation at ``p`` through the knots (x, y); outside
    their range the end values are kept (out_of_bounds='clip').  The knots next to each row are found
    by an as-of join, so neither plan nor task grows with the knots.  Where knots share an x, the
    last one holds at x and the first one before it."""
    names = [c for c in df.columns if c != out]
    d = between_marks(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{p}`").cast("double").alias("_q")),
                      "_q", knots.select("x", "y"), "x")
    x0, y0, x1, y1 = (F.col(f"{a}.{b}") for a in ("before", "after") for b in "xy")
    value = F.coalesce(y0 + (y1 - y0) * (F.col("_q") - x0) / (x1 - x0), y0, y1)
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in names], value.alias(out))


def fit(df: DataFrame, z: str, y: str, method: str = "temperature", l2: float = L2_REG,
        clamp: tuple | None = T_CLAMP, min_nodes: int = MIN_ISO_NODES,
        balanced: bool = True) -> Calibrator:
    """``l2=0, clamp=None, balanced=False, min_nodes=0`` gives the older variant
    without ridge, clamp, weights or guard."""
    if method == "platt":
        raise ValueError("platt is accepted by the reference CLI but has no fit; not supported")
    cal = Calibrator(method=method, clamp=clamp)
    if method in ("temperature", "temperature+isotonic"):
        cal.T, _ = fit_temperature(df, z, y, l2, clamp)
    if method in ("isotonic", "temperature+isotonic"):
        pz = sigmoid_stable(cal.logits(F.col(z)))
        knots = isotonic_knots(df.withColumn("_p", pz), "_p", y, min_nodes, balanced)
        cal.isotonic_skipped = knots is None
        cal.knots = knots
    if method not in ("temperature", "isotonic", "temperature+isotonic"):
        raise ValueError(f"unknown calibration method {method!r}")
    return cal


def calibrated_ensemble(df: DataFrame, cols: list[str], cal_table: DataFrame, key: str = "ID",
                        out: str = "p") -> DataFrame:
    """Per-model temperature (table model -> T) applied to each model's logit, then the
    mean.  Models are stacked as rows and joined to the calibration table on model
    (one row per model, broadcast)."""
    from ..functions.prob import logit
    m = len(cols)
    stk = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("_p")) for c in cols])))
    j = stk.join(F.broadcast(cal_table), "model")
    t = F.least(F.greatest(F.col("T"), F.lit(T_CLAMP[0])), F.lit(T_CLAMP[1]))  # clamped where it is applied
    p = clip(sigmoid_stable(logit(clip(F.col("_p"), EPS_LOGIT, 1 - EPS_LOGIT)) / t), EPS_LOGIT, 1 - EPS_LOGIT)
    return j.groupBy(key).agg((F.sum(p) / F.lit(float(m))).alias(out))
