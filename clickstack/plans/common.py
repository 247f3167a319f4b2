"""Shared output hygiene for registered queries.

Computed doubles are rounded once, in the outermost projection, so that sums that differ in
the last bits between engines compare equal: to 6 decimals, or to 6 significant digits
below 0.001, so that small values (class weights of a large table) do not vanish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DECIMALS = 6


def rounded(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            x = F.col(f.name).cast("double")
            small = (F.abs(x) < 1e-3) & (F.abs(x) > 1e-12)
            cols.append(F.when(small, F.format_string(f"%.{decimals - 1}e", x).cast("double"))
                        .otherwise(F.round(x, decimals)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
