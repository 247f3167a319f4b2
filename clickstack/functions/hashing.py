"""Category and group hashing as JVM-side column expressions.

Two modes:
* ``xxhash`` (default): ``xxhash64`` of the value's string form; fastest, stays in codegen.
* ``md5``: first 8 hex digits of ``md5(string)`` as an unsigned 32-bit int.  Portable:
  DuckDB and Python's hashlib give the same numbers, so it is used by the oracle checks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket defaults and the group-hash modulus.
DEFAULT_BUCKETS = 1000003
GROUP_MODULUS = 2147483647  # 2**31 - 1
NA = "NA"
SEP = "\u001f"  # unit separator, never part of a category value


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_category_string(c) -> Column:
    """String form of a category, null -> 'NA'."""
    return F.coalesce(_col(c).cast("string"), F.lit(NA))


def md5_u32(s) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5(s)."""
    return F.conv(F.substring(F.md5(_col(s)), 1, 8), 16, 10).cast("long")


def md5_u60(s) -> Column:
    """Unsigned 60-bit integer from the first 15 hex digits of md5(s): for draws, whose
    pools may hold more than 2**32 rows."""
    return F.conv(F.substring(F.md5(_col(s)), 1, 15), 16, 10).cast("long")


def bucket(c, m: int, mode: str = "xxhash") -> Column:
    """Bucket id in [0, m) of a category column (null -> 'NA')."""
    s = as_category_string(c)
    if mode == "md5":
        return F.pmod(md5_u32(s), F.lit(int(m))).cast("int")
    if mode == "xxhash":
        return F.pmod(F.xxhash64(s), F.lit(int(m))).cast("int")
    raise ValueError(f"unknown hash mode {mode!r}")


def group_hash(cols, mode: str = "xxhash") -> Column:
    """Group id in [0, 2**31-1) from one or more columns, each null -> 'NA'."""
    parts = [as_category_string(c) for c in cols]
    if mode == "md5":
        s = parts[0] if len(parts) == 1 else F.concat_ws(SEP, *parts)
        return F.pmod(md5_u32(s), F.lit(GROUP_MODULUS))
    if mode == "xxhash":
        return F.pmod(F.xxhash64(*parts), F.lit(GROUP_MODULUS))
    raise ValueError(f"unknown hash mode {mode!r}")


def hash_fraction(cols, seed: int) -> Column:
    """Reproducible uniform draw in [0, 1) from key columns and a seed (md5 based)."""
    parts = [F.lit(str(seed))] + [as_category_string(c) for c in cols]
    return md5_u60(F.concat_ws(SEP, *parts)) / F.lit(float(1 << 60))
