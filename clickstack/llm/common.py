"""Shared helpers: text batches as flat NumPy buffers, word codes, union of local links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_map, ship  # noqa: F401
from ..operators.joins import join_sized  # noqa: F401
from ..operators.rowindex import global_ordinal
from ..session import cut_lineage

SLICE_BYTES = 2 << 20  # texts handled together inside a task; a longer text goes alone
ODD = np.uint64(0x9E3779B97F4A7C15)


def ids_are_keys(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether every row has a ``key`` of its own."""
    ids = docs.select(F.col(key).cast("long").alias("id"))
    return ids.groupBy("id").count().where("count > 1 or id is null").isEmpty()


def row_keys(docs: DataFrame, out: str = "doc", key: str = "doc_id") -> DataFrame:
    """``docs`` with the long ``out``, one of its own for every row, in the order of ``key`` (null last;
    rows that share it in an order that a rerun keeps).

    Where every row has an id of its own, that is it.  Otherwise rows are written with a number and
    only (id, number) is sorted."""
    if ids_are_keys(docs, key):
        return docs.withColumn(out, F.col(key).cast("long"))
    rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    order = global_ordinal(rows.select(F.col(key).cast("long").alias("_id"), "_row"), [F.col("_id").asc_nulls_last(), F.col("_row")], out)
    return cut_lineage(rows.join(order.select("_row", out), "_row").drop("_row"), "keyed-rows")


def text_slices(batches, columns: list[str], text: str,
                limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, UTF-8 bytes, offsets) in slices of about ``limit`` bytes; null text is empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
        offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset:]
        data = (np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size
                else np.empty(0, np.uint8))
        rows = batch.select(columns)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield rows.slice(i, j - i), data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            i = j


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 ``data`` and the offsets in code points."""
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return cps, lead[offs]


@lru_cache(maxsize=1)
def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of each code point; class 0 other, 1 letter, 2 capital, 3 digit."""
    n = 0x110000
    cls, low = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32)
    for cp in range(n):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if ch.isalpha():
            lower = ch.lower()
            cls[cp] = 2 if lower != ch else 1
            low[cp] = ord(lower) if len(lower) == 1 else cp
        elif ch.isnumeric():
            cls[cp] = 3
    return cls, low


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = np.uint64(pow(int(ODD), -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, ODD), out=up[1:])
        np.multiply.accumulate(np.full(n - 1, inv), out=down[1:])
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, ``n`` of each at least."""
    return _powers(1 << max(10, int(n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of value * multiplier**position, with a leading zero; any span's hash
    is ``(out[end] - out[start]) * inverse_power[start]``."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` items over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
        if np.array_equal(before, label):
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label
