"""Exact order statistics of many columns by bracket and count.

A mergeable quantile sketch gives two values around the middle; a count of the rows below and
between them says which places are still open; the sketch is taken again over the open rows until
few are left, and those are fetched.  Every step is one scan with one aggregation row per task: no
row, cell or value is shuffled.  A round leaves at most a thousandth of the open rows, so two scans
do for 20 million rows and four for 2 * 10**10."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000   # rank error of the sketch: a 10,000th of its rows
MARGIN = 4          # the ends lie that many rank errors off the middle
OPEN_VALUES = 20_000  # open values of a column that are fetched


@dataclass
class _Search:
    """Places (from 1) that are wanted among all rows of a column, and what is known of them."""

    wanted: list
    found: dict
    low: float = -math.inf   # open rows lie strictly between low and high once ``below`` is known
    high: float = math.inf
    below: int = 0           # rows up to and including low
    open: int = 0
    bounded: bool = False    # False while rows equal to an infinity are open as well

    def places(self) -> list:
        return [p for p in self.wanted if p not in self.found]


def _number(c: str) -> Column:
    """The column as double; NaN takes the place of infinity, above which it sorts."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), F.lit(math.inf)).otherwise(x)


def _open(s: _Search, x: Column) -> Column:
    return F.when((x > s.low) & (x < s.high), x) if s.bounded else x


def _sketch(s: _Search, x: Column) -> Column:
    if s.bounded:
        at = [(p - s.below) / s.open for p in s.places()]
        lo, hi = min(at), max(at)
    else:
        lo = hi = 0.5
    ends = [max(0.0, lo - MARGIN / ACCURACY), min(1.0, hi + MARGIN / ACCURACY)]
    return F.percentile_approx(_open(s, x), ends, ACCURACY)


def _counts(x: Column, low: float, high: float) -> list[Column]:
    return [F.count(F.when(c, 1)) for c in (x < low, x <= low, x < high, x <= high)]


def _row(df: DataFrame, cols: list[Column]) -> list:
    return list(df.agg(*[c.alias(f"_a{i}") for i, c in enumerate(cols)]).first()) if cols else []


def middle_values(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """The median of each column: the middle value, or the mean of the two middle ones; None for a
    column without values, NaN where a NaN is in the middle."""
    df = df.select(*[_number(c).alias(f"_n{i}") for i, c in enumerate(cols)],
                   *[F.isnan(F.col(c).cast("double")).alias(f"_q{i}") for i, c in enumerate(cols)])
    xs = [F.col(f"_n{i}") for i in range(len(cols))]
    first = _row(df, [a for i, x in enumerate(xs) for a in (
        F.count(x), F.count(F.when(F.col(f"_q{i}"), 1)), _sketch(_Search([], {}), x))])
    searches, numbers, ends = [], [], []
    for i in range(len(cols)):
        n, nans, around = first[3 * i:3 * i + 3]
        numbers.append(n - nans)
        searches.append(_Search([(n + 1) // 2, n // 2 + 1] if n else [], {}, open=n))
        ends.append(around)
    active = [i for i, s in enumerate(searches) if s.wanted]
    while active:
        # the rows between the ends are few enough to come along with the counts, if their bound is
        few = {i for i in active if 2 * (MARGIN + 1) * searches[i].open <= ACCURACY * OPEN_VALUES}
        asked = [a for i in active for a in (
            *_counts(xs[i], *ends[i]),
            F.sort_array(F.collect_list(F.when((xs[i] > ends[i][0]) & (xs[i] < ends[i][1]), xs[i]))) if i in few else F.lit(None))]
        got = _row(df, asked)
        for k, i in enumerate(active):
            s, (lt_low, le_low, lt_high, le_high, values) = searches[i], got[5 * k:5 * k + 5]
            low, high = ends[i]
            for p in s.places():
                if lt_low < p <= le_low:
                    s.found[p] = low
                elif lt_high < p <= le_high:
                    s.found[p] = high
                elif not le_low < p <= lt_high:
                    raise RuntimeError("a sketch missed its rank")
                elif values is not None:
                    s.found[p] = values[p - le_low - 1]
            s.low, s.high, s.below, s.open, s.bounded = low, high, le_low, lt_high - le_low, True
        active = [i for i in active if searches[i].places()]
        for i, around in zip(active, _row(df, [_sketch(searches[i], xs[i]) for i in active])):
            ends[i] = around
    out = {}
    for i, (c, s) in enumerate(zip(cols, searches)):
        at = [math.nan if p > numbers[i] else s.found[p] for p in s.wanted]
        out[c] = None if not at else at[0] if at[0] == at[1] else (at[0] + at[1]) / 2
    return out
