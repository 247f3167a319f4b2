"""Combining model outputs per row (wide table, one column per model) and blending
two prediction tables."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prob import EPS_LOGIT, clip, logit, sigmoid
from ..session import cut_lineage
from .joins import join_sized
from .rowindex import global_ordinal, running_totals

METHODS = ("mean", "geom_mean", "logit_mean", "median", "trim_mean", "rank_avg", "weighted")


def _mean(cols: list[Column], m: int) -> Column:
    return reduce(add, cols) / F.lit(float(m))


def _wsum(cols: list[Column], weights: list[float]) -> Column:
    return reduce(add, [c * F.lit(float(w)) for c, w in zip(cols, weights)])


def _sorted(cols: list[Column]) -> list[Column]:
    a = F.array_sort(F.array(*cols))
    return [F.element_at(a, i + 1) for i in range(len(cols))]


def trim_k(m: int, ratio: float) -> int:
    """k = round(M * ratio), at most (M-1)//2 so the middle slice is never empty."""
    return int(max(0, min((m - 1) // 2, round(m * ratio))))


def normalise_weights(weights: list[float], m: int) -> list[float]:
    if len(weights) != m:
        raise ValueError("weights length must match the number of models")
    s = float(sum(weights))
    return [float(w) / s for w in weights]


def combine(df: DataFrame, cols: list[str], method: str = "logit_mean",
            weights: list[float] | None = None, trim_ratio: float = 0.0,
            key: str = "ID", out: str = "p", clamp: bool = True) -> DataFrame:
    """Ensemble per row.  Inputs are clamped to [1e-7, 1-1e-7] first; a single model
    passes through."""
    m = len(cols)
    base = df.select("*", *[clip(F.col(c).cast("double"), EPS_LOGIT, 1 - EPS_LOGIT).alias(f"_c{i}")
                            for i, c in enumerate(cols)]) if clamp else \
        df.select("*", *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    cc = [f"_c{i}" for i in range(m)]
    a = [F.col(c) for c in cc]
    w = normalise_weights(weights, m) if weights is not None else None
    if m == 1:
        val = F.col(cc[0])
    elif method == "mean":
        val = _mean(a, m) if w is None else _wsum(a, w)
    elif method == "geom_mean":
        la = [F.ln(clip(x, EPS_LOGIT, 1 - EPS_LOGIT)) for x in a]
        val = F.exp(_mean(la, m) if w is None else _wsum(la, w))
    elif method == "logit_mean":
        la = [logit(x) for x in a]
        val = sigmoid(_mean(la, m) if w is None else _wsum(la, w))
    elif method == "median":
        val = _sorted(a)[(m - 1) // 2]  # lower middle for even M
    elif method == "trim_mean":
        k = trim_k(m, trim_ratio)
        val = _mean(a, m) if k == 0 else _mean(_sorted(a)[k:m - k], m - 2 * k)
    elif method == "weighted":
        if w is None:
            raise ValueError("give one weight per model for the weighted ensemble")
        val = _wsum(a, w)
    elif method == "rank_avg":
        return rank_average(base, cc, key, out).drop(*cc)
    else:
        raise ValueError(f"unknown ensemble method {method!r}")
    return base.withColumn(out, val).drop(*cc)


def rank_average(df: DataFrame, cols: list[str], key: str = "ID", out: str = "p") -> DataFrame:
    """Mean over models of the ordinal rank (r+1)/(n+1), r = position in (p, key) order
    over the WHOLE table.  Models are stacked as rows so one global sort serves all."""
    m = len(cols)
    stacked = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_p")) for i, c in enumerate(cols)])))
    n = df.agg(F.count(F.lit(1))).scalar()
    ordd = global_ordinal(stacked, ["_m", "_p", key], "_o")
    # ordinal inside a model = global ordinal - i * n (every model has n rows)
    r = (F.col("_o") - F.col("_m") * n + 1) / (n + 1)
    avg = ordd.groupBy(key).agg((F.sum(r) / F.lit(float(m))).alias(out))
    return df.join(avg, key, "left")


def val_weights(metrics: DataFrame, score_col: str = "score", model_col: str = "model",
                temperature: float = 10.0) -> DataFrame:
    """softmax(score / T) over models (one row per model, so the window is tiny)."""
    t = max(1e-6, float(temperature))
    w = Window.partitionBy()
    s = F.col(score_col) / F.lit(t)
    e = F.exp(s - F.max(s).over(w))
    return metrics.select(model_col, (e / F.sum(e).over(w)).alias("weight"))


# ---------------------------------------------------------------- two-table blends
def unique_rows(df: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """(key, ``out``): one row per key; a repeated key fails the job that reads it.  The
    grouping leaves the rows partitioned by key, as the join after it needs them."""
    one = df.groupBy(key).agg(F.max(F.col("clicked").cast("double")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    refuse = F.raise_error(F.concat(F.lit(f"{name}: repeated {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return one.select(key, F.when(F.col("_n") == 1, F.col("_p")).otherwise(refuse.cast("double")).alias(out))


def blend_join(a: DataFrame, b: DataFrame, key: str = "ID", check: bool = True) -> DataFrame:
    """Inner one-to-one join of two (ID, clicked) tables; with ``check`` repeated keys fail."""
    if check:
        return unique_rows(a, key, "first table", "clicked_1").join(
            unique_rows(b, key, "second table", "clicked_2"), key, "inner")
    return a.select(key, F.col("clicked").cast("double").alias("clicked_1")).join(
        b.select(key, F.col("clicked").cast("double").alias("clicked_2")), key, "inner")


def blend(a: DataFrame, b: DataFrame, method: str = "logit_mean", w: float = 0.5,
          key: str = "ID", check: bool = True) -> DataFrame:
    j = blend_join(a, b, key, check)
    p1, p2 = F.col("clicked_1"), F.col("clicked_2")
    if method == "mean":
        val = w * p1 + (1.0 - w) * p2
    elif method == "logit_mean":
        val = sigmoid(w * logit(p1) + (1.0 - w) * logit(p2))
    elif method == "rank_mean":
        # the joined rows are written once; both columns are ranked as one stacked table of distinct values
        j = cut_lineage(j, "blend")
        cells = j.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), p.alias("_v")) for i, p in ((1, p1), (2, p2))])))
        upto = running_totals(cells.groupBy("_m", "_v").agg(F.count(F.lit(1)).alias("_n")), ["_v"], ["_n"], ["_m"], inclusive=False)
        ranks = cut_lineage(upto.select("_m", "_v", (F.col("cum__n") + (F.col("_n") + 1) / 2.0).alias("_r"), "_n"), "ranks")
        for i in (1, 2):
            of = ranks.where(F.col("_m") == i).select(F.col("_v").alias(f"clicked_{i}"), F.col("_r").alias(f"_r{i}"), F.col("_n").alias(f"_n{i}"))
            j = join_sized(j, of, [f"clicked_{i}"], f"_n{i}")
        den = F.lit(float(ranks.where("_m = 1").agg(F.sum("_n")).first()[0] or 0) - 1) + F.lit(1e-12)
        val = w * (F.col("_r1") - 1) / den + (1.0 - w) * (F.col("_r2") - 1) / den
    else:
        raise ValueError(f"unknown blend method {method!r}")
    return j.select(F.col(key).cast("string").alias(key),
                    clip(val, EPS_LOGIT, 1 - EPS_LOGIT).alias("clicked"))


def blend_diagnostics(a: DataFrame, b: DataFrame, method: str = "logit_mean", w: float = 0.5,
                      key: str = "ID") -> DataFrame:
    """Correlation and means on the joined rows (not file order)."""
    j = blend_join(a, b, key, check=False)
    ens = sigmoid(w * logit(F.col("clicked_1")) + (1 - w) * logit(F.col("clicked_2"))) \
        if method == "logit_mean" else w * F.col("clicked_1") + (1 - w) * F.col("clicked_2")
    ens = clip(ens, EPS_LOGIT, 1 - EPS_LOGIT)
    return j.agg(F.corr("clicked_1", "clicked_2").alias("corr"), F.avg("clicked_1").alias("mean_1"),
                 F.avg("clicked_2").alias("mean_2"), F.avg(ens).alias("mean_ens"))
