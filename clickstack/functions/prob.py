"""Probability / logit helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clip constants of the reference metrics and blends.
EPS_LOGIT = 1e-7
EPS_METRIC = 1e-12
SIGMOID_CLIP = 50.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_col(c), F.lit(lo)), F.lit(hi))


def hygiene(p) -> Column:
    """NaN -> 0.5, +inf -> 1, -inf -> 0 (then callers clip)."""
    c = _col(p).cast("double")
    return (F.when(F.isnan(c), F.lit(0.5))
            .when(c == float("inf"), F.lit(1.0))
            .when(c == float("-inf"), F.lit(0.0))
            .otherwise(c))


def logit(p, eps: float = EPS_LOGIT) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q) - F.ln(F.lit(1.0) - q)


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))


def sigmoid_stable(z) -> Column:
    return sigmoid(clip(z, -SIGMOID_CLIP, SIGMOID_CLIP))


def softplus(z) -> Column:
    """log(1 + exp(z)) without overflow."""
    c = _col(z)
    return F.log1p(F.exp(-F.abs(c))) + F.greatest(c, F.lit(0.0))
