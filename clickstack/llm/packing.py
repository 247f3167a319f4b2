"""Packing by cutting-stock column generation.

Documents become token ids; each is cut into whole sequences and one remainder.  The
histogram of remainder lengths, in steps of ``unit`` tokens, is bounded by
``seq_len / unit`` rows whatever the number of documents, so only that histogram reaches
the driver.  There a linear program over filling patterns is solved by column generation:
a knapsack dynamic program prices the next pattern from the duals.  Pattern counts are
rounded down, the pieces left are solved again while that gives whole counts, the last few are
filled greedily, and every pattern's slots are
ranges of ranks, so pieces (ranked by document within their length class) find their
sequence by a broadcast join on those ranges.

Defined cases: a null text counts as empty (one piece, the end id alone); repeated rows
are packed once each; runs of blanks or of one word may have any length; extra columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rowindex import global_ordinal
from ..session import cut_lineage
from .common import arrow_map

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


LONG_RUN = 4096  # bytes


def has_long_run(text: str) -> bool:
    """More than LONG_RUN bytes without a change between ASCII white space and other bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= LONG_RUN:
        return False
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return bool(np.diff(np.concatenate([[0], turns, [len(data)]])).max() > LONG_RUN)


def encoder(path: str, ranks: str | None = None):
    """``text -> list of ids`` from a tokenizer file (JSON).  ``ranks`` names the same vocabulary as
    ranks, whose reader gives the same ids in a third of the time, but fails on very long blank runs
    and takes quadratic time for very long words: texts with such a run are left to the JSON form."""
    if ranks:
        fast, exact = encoder(ranks), None

        def either(text):
            nonlocal exact
            if not has_long_run(text):
                return fast(text)
            exact = exact or encoder(path)
            return exact(text)
        return either
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={"<|endoftext|>": len(ranks)})
        return lambda text: enc.encode(text, allowed_special="all")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1,
                 keep_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: whole sequences first, then the remainder.  ``keep_ids`` adds the
    ids themselves (``ids`` array<int>)."""
    def pieces(batches):
        encode = encoder(tokenizer_path, ranks_path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc_id, text in zip(doc_ids, texts):
                ids = np.array(encode(text or "") + [end_id], "<u4")
                for s in range(0, len(ids), seq_len):
                    cut = ids[s:s + seq_len]
                    row = (doc_id, s, len(cut), zlib.crc32(cut.tobytes()), len(ids))
                    for col, v in zip(out, row + ((cut.astype(np.int32),) if keep_ids else ())):
                        col.append(v)
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, pieces, PIECES + (", ids array<int>" if keep_ids else ""))


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack: the most valuable multiset of ``sizes`` (ascending) within ``room``."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for u in range(1, room + 1):
        best[u] = best[u - 1]
        if k := upto[u]:
            cand = best[u - sizes[:k]] + values[:k]
            j = int(cand.argmax())
            if cand[j] > best[u] + 1e-12:
                best[u], take[u] = cand[j], j
    counts, u = np.zeros(len(sizes), np.int64), room
    while u > 0:
        if take[u] < 0:
            u -= 1
        else:
            counts[take[u]] += 1
            u -= int(sizes[take[u]])
    return float(best[room]), counts


def fullest(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The largest size left, then the subset of ``left`` that fills its sequence best
    (reachable fillings as the bits of an integer)."""
    p = np.zeros(len(sizes), np.int64)
    big = int(np.flatnonzero(left)[-1])
    p[big] = 1
    space = room - int(sizes[big])
    mask, reach, steps = (1 << (space + 1)) - 1, 1, []
    for i in np.flatnonzero((left > p) & (sizes <= space))[::-1]:
        size = int(sizes[i])
        for _ in range(min(math.ceil(left[i] - p[i]), space // size)):
            new = (reach | reach << size) & mask
            if new == reach:
                break
            steps.append((int(i), size, reach))
            reach = new
        if reach >> space & 1:
            break
    at = reach.bit_length() - 1
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            p[i] += 1
            at -= size
    return p


def fill(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) by taking the fullest pattern again and again; each uses up a size."""
    left, plan = demand.copy(), []
    while left.any():
        p = fullest(sizes, left, room)
        used = p > 0
        times = int((left[used] // p[used]).min())
        left -= p * times
        plan.append((p, times))
    return plan


def first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (columns), the inverse of that matrix, and the patterns' counts.

    Every filling step uses up a size that no later pattern has, so with a unit pattern for
    sizes used up beside it the columns are triangular, and the inverse follows row by row."""
    m = len(sizes)
    left, columns, counts, owner, done = demand.copy(), [], [], [], np.zeros(m, bool)
    while left.any():
        p = fullest(sizes, left, room)
        used = p > 0
        short = left[used] / p[used]
        step = float(short.min())
        scarce = np.flatnonzero(used)[int(short.argmin())]
        left -= p * step
        left[left < 1e-7] = 0  # used up, but for rounding
        left[scarce] = 0
        done[scarce] = True
        columns.append(p)
        counts.append(step)
        owner.append(scarce)
        for i in np.flatnonzero(used & (left == 0) & ~done):
            columns.append(np.eye(1, m, i, dtype=np.int64)[0])
            counts.append(0.0)
            owner.append(i)
            done[i] = True
    basis = np.array(columns).T
    inverse = np.zeros((m, m))  # row k belongs to column k, which alone of columns from k on has size owner[k]
    for k, i in enumerate(owner):
        row = basis[i, :k]
        before = np.flatnonzero(row)
        unit = np.zeros(m)
        unit[i] = 1
        inverse[k] = (unit - (row[before, None] * inverse[before]).sum(axis=0)) / basis[i, k]
    return basis, inverse, np.array(counts)


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, fractional counts) by column generation, to a relative ``gap`` from
    the Farley bound or for ``rounds`` pivots.  (Sums instead of matrix products: the driver's
    BLAS threads can hang beside the JVM.)"""
    basis, inverse, x = first_basis(sizes, demand.astype(float), room)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, counts = price(duals, sizes, room)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= max(0.5, gap * x.sum()):
            break
        used = np.flatnonzero(counts)
        d = (inverse[:, used] * counts[used]).sum(axis=1)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        x -= ratio[r] * d
        x[r] += ratio[r]
        np.maximum(x, 0, out=x)
        basis[:, r] = counts
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
    return basis, x


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4,
                     rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) covering ``demand`` exactly.  The program over fractional counts is
    solved and rounded down, and solved again for the pieces left while that gives whole
    counts; the last pieces, less than a sequence's worth for each pattern, are filled
    greedily."""
    left, plan = demand.astype(np.int64).copy(), []
    while left.any():
        at = np.flatnonzero(left)
        basis, x = solve(sizes[at], left[at], room, gap, rounds)
        before = len(plan)
        for some, times in zip(basis.T, np.floor(x + 1e-7).astype(np.int64)):
            p = np.zeros(len(sizes), np.int64)
            p[at] = some
            used = p > 0
            times = int(min(times, (left[used] // p[used]).min()))
            if times > 0:
                left -= p * times
                plan.append((p, times))
        if len(plan) == before:
            break
    return plan + fill(sizes, left, room)


def slot_table(plan: list[tuple[np.ndarray, int]], sizes: np.ndarray, starts: np.ndarray) -> list[tuple]:
    """``starts``: rank of each class's first piece.  (class, first rank, end rank, pieces per sequence, first sequence, place in pattern)."""
    rank, first, rows = starts.copy(), 0, []
    for p, times in plan:
        for place, i in enumerate(np.flatnonzero(p)[::-1]):
            n = int(p[i]) * times
            rows.append((int(sizes[i]), int(rank[i]), int(rank[i]) + n, int(p[i]), first, place))
            rank[i] += n
        first += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, unit: int = 2,
         keep_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; sequences hold ``seq_len`` tokens at most."""
    if seq_len % unit:
        raise ValueError("seq_len must be a multiple of unit")
    spark = docs.sparkSession
    pieces = cut_lineage(token_pieces(docs, tokenizer_path, seq_len, end_id, keep_ids, ranks_path), "pieces")
    narrow = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                           F.ceil(F.col("length") / unit).cast("int").alias("class"))
    hist = narrow.groupBy("class").count().orderBy("class").collect()  # seq_len / unit rows at most
    sizes = np.array([r[0] for r in hist], np.int64)
    demand = np.array([r[1] for r in hist], np.int64)
    plan = cutting_patterns(sizes, demand, seq_len // unit) if len(hist) else []
    slots = spark.createDataFrame(slot_table(plan, sizes, np.cumsum(demand) - demand), "class int, lo long, hi long, per long, first long, place int")
    ranked = global_ordinal(narrow, ["class", "doc_id", "start", "ids_crc32"], out="rank")
    t = F.col("rank") - F.col("lo")
    placed = (ranked.alias("r").join(F.broadcast(slots).alias("s"), "class")  # slots: bounded by patterns
              .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
              .withColumn("sequence_id", F.col("first") + F.floor(t / F.col("per")).cast("long"))
              .withColumn("item", t % F.col("per")))
    before = (Window.partitionBy("sequence_id").orderBy("place", "item")
              .rowsBetween(Window.unboundedPreceding, -1))
    out = placed.select(*[c.split()[0] for c in PIECES.split(", ")], "sequence_id",
                        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    if keep_ids:
        out = out.join(pieces.select("doc_id", "start", "ids_crc32", "ids").dropDuplicates(["doc_id", "start", "ids_crc32"]),
                       ["doc_id", "start", "ids_crc32"], "left")
    return out
