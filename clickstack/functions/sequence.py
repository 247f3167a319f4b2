"""Click-history sequence parsing: string of comma separated ints -> array<int>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_int_array() -> Column:
    return F.array().cast("array<int>")


def parse_lenient(seq) -> Column:
    """Split on ',' and try-cast each piece; junk and empty pieces stay as null
    elements (see ``counted_positions``).  Null sequence -> empty array."""
    # array-level try_cast keeps per-element nulls and stays in whole-stage codegen; ``seq`` occurs once, since
    # Spark would work out an expression that occurs twice as often
    return F.coalesce(F.split(_col(seq), ",").try_cast("array<int>"), empty_int_array())


def counted_positions(arr) -> Column:
    """array<struct<pos, token>>: pos counts the tokens that are not null up to and with this
    one, less 1 (a junk token keeps the position of the token before it)."""
    a = _col(arr)
    plain = F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.alias("token")))
    kind = "array<struct<pos:int,token:int>>"

    def step(acc, x):
        n = acc["n"] + x.isNotNull().cast("int")
        return F.struct(n.alias("n"), F.concat(acc["out"], F.array(F.struct((n - 1).alias("pos"), x.alias("token")))).alias("out"))
    junk = F.aggregate(a, F.struct(F.lit(0).alias("n"), F.array().cast(kind).alias("out")), step)["out"]
    return F.when(F.exists(a, lambda t: t.isNull()), junk).otherwise(plain)


def valid_positions(arr) -> Column:
    """``counted_positions`` of the tokens that are not null, without the others."""
    return F.transform(F.array_compact(_col(arr)), lambda x, i: F.struct(i.alias("pos"), x.alias("token")))


def parse_strict(seq) -> Column:
    """Split on ',', skip empty pieces, cast each to int (a bad token raises under ANSI)."""
    s = F.coalesce(_col(seq), F.lit(""))
    return F.array_remove(F.split(s, ","), "").cast("array<int>")


def tail(arr, k: int) -> Column:
    """Last ``k`` elements (newest last); shorter arrays are kept whole."""
    a = _col(arr)
    return F.when(F.size(a) > k, F.slice(a, -k, k)).otherwise(a)


def left_pad(arr, length: int, pad_id: int = 0) -> Column:
    """Keep the last ``length`` elements and left-pad with ``pad_id`` to ``length``."""
    t = tail(arr, length)
    return F.concat(F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(t)), t)


def recency_weight(pos, tau: float) -> Column:
    """exp(-pos / tau)."""
    return F.exp(-_col(pos).cast("double") / F.lit(float(tau)))


def time_bin(mode: str | None) -> Column | None:
    """'day_of_week_hour' -> dow*24+hour; a column name -> that column as int; None -> no bin."""
    if mode is None or mode == "none":
        return None
    if mode == "day_of_week_hour":
        return F.col("day_of_week").cast("int") * 24 + F.col("hour").cast("int")
    return F.col(mode).cast("int")
