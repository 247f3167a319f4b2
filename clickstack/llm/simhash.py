"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: words of the text with A-Z lower-cased, shingles of ``width`` words
(repeats count), XXH64 of each, majority per bit.  Equal fingerprints are merged first, so
copies cost one row.  Two fingerprints within ``max_bits`` agree on one of
``max_bits + 1`` bit blocks; a block's value deals them to tasks (values that hold more
than ``hot`` fingerprints are dealt a second time by blocks of the remaining bits).
Inside a task the fingerprints of each block value are sorted by Gray rank; a tree over
runs of ``FAN`` neighbours keeps the bits its members share, factored into the highest node
that has them.  A search adds up the differences on the way down and drops a whole group
once they exceed ``max_bits``, or once the group is already linked to the query, so a
group of near copies does not cost all its pairs.  Tasks emit one link per fingerprint to
its local group; the groups are joined up by ``components``.

Defined cases: null and empty texts have fingerprint zero, which links like any other;
repeated rows keep their own output row; a null doc_id links texts but names no component
(null where no row of the component has one); extra columns are ignored; an empty table gives
an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rowindex import global_ordinal
from ..session import cut_lineage
from .common import arrow_map, join_sized, local_components, text_slices
from .components import components

# The five multipliers of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
FAN = 8


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans of ``data``: spans of one length are hashed together."""
    out, s = np.empty(len(start), np.uint64), np.uint64(seed)
    if not len(start):
        return out
    buf = np.concatenate([data, np.zeros(32, np.uint8)])
    words = np.lib.stride_tricks.as_strided(buf.view(np.uint8), (len(buf) - 7, 8), (1, 1))
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    with np.errstate(over="ignore"):
        for group in np.split(order, cuts):
            n, at = int(length[group[0]]), start[group]

            def lane(i: int, size: int = 8) -> np.ndarray:
                w = np.ascontiguousarray(words[at + i]).view("<u8").ravel()
                return w if size == 8 else w & np.uint64((1 << (8 * size)) - 1)

            i = 0
            if n >= 32:
                v = [np.broadcast_to(x, at.shape) for x in (s + P1 + P2, s + P2, s, s - P1)]
                while i + 32 <= n:
                    v = [_round(a, lane(i + 8 * k)) for k, a in enumerate(v)]
                    i += 32
                h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
                for a in v:
                    h = (h ^ _round(np.uint64(0), a)) * P1 + P4
            else:
                h = np.full(at.shape, s + P5, np.uint64)
            h = h + np.uint64(n)
            while i + 8 <= n:
                h = _rot(h ^ _round(np.uint64(0), lane(i)), 27) * P1 + P4
                i += 8
            if i + 4 <= n:
                h = _rot(h ^ (lane(i, 4) * P1), 23) * P2 + P3
                i += 4
            while i < n:
                h = _rot(h ^ (lane(i, 1) * P5), 11) * P1
                i += 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[group] = h ^ (h >> np.uint64(32))
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def fingerprints(data: np.ndarray, offs: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each text of a slice (UTF-8 ``data`` cut at ``offs``)."""
    n_docs = len(offs) - 1
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True  # a text's first byte starts a word of its own
    begins = ~space
    begins[1:] &= space[:-1] | first[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | first[1:-1]
    ws, we = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = we - ws
    # the words again, one space after each
    total = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(int(total[-1]), 32, np.uint8)
    solid = np.flatnonzero(~space)
    flat[np.arange(len(solid)) + np.repeat(np.arange(len(ws)), size)] = _LOWER[data[solid]]
    w0 = np.searchsorted(ws, offs)  # first word of each text
    n_words = np.diff(w0)
    n_sh = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    sh0 = np.concatenate([[0], np.cumsum(n_sh)])
    owner = np.repeat(np.arange(n_docs), n_sh)
    first_word = w0[:-1][owner] + np.arange(int(sh0[-1])) - sh0[:-1][owner]
    last_word = first_word + np.minimum(width, n_words[owner]) - 1
    start = total[first_word]
    h = xxh64(flat, start, total[last_word + 1] - 1 - start)
    out = np.zeros(n_docs, np.uint64)
    some = np.flatnonzero(n_sh)
    step = 1 << 16
    votes = np.zeros((n_docs, 64), np.int64)
    for i in range(0, len(h), step):
        bits = np.unpackbits(h[i:i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[i:i + step]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        votes[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    major = (2 * votes[some] > n_sh[some, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_rows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row."""
    def run(batches):
        for rows, data, offs in text_slices(batches, ["doc_id"], "text"):
            fp = fingerprints(data, offs, width)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Trees over the fingerprints of several groups (``group`` ascending, Gray rank inside)."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.order, self.fp, self.group = order, fp[order], group[order]
        # levels from the leaves up: first child, number of children, shared bits, pattern
        self.levels = [dict(lo=np.arange(len(fp)), n=np.ones(len(fp), np.int64),
                            same=np.full(len(fp), ~np.uint64(0)), pattern=self.fp, group=self.group)]
        while True:
            below = self.levels[-1]
            g = below["group"]
            head = np.concatenate([[True], g[1:] != g[:-1]])
            if head.all():
                break
            place = np.arange(len(g)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            lo = np.flatnonzero(place % FAN == 0)
            n = np.diff(np.append(lo, len(g)))
            every = np.bitwise_and.reduceat(below["pattern"], lo)
            some = np.bitwise_or.reduceat(below["pattern"], lo)
            same = np.bitwise_and.reduceat(below["same"], lo) & ~(every ^ some)
            self.levels.append(dict(lo=lo, n=n, same=same, pattern=every & same, group=g[lo]))
        for up, down in zip(self.levels[::-1], self.levels[-2::-1]):
            parent = np.repeat(np.arange(len(up["lo"])), up["n"])
            down["own"] = down["same"] & ~up["same"][parent]  # bits that no upper node has told
        top = self.levels[-1]
        top["own"] = top["same"]

    def linked(self, max_bits: int, chunk: int = 4096) -> np.ndarray:
        """Smallest index (of the sorted order) linked to each fingerprint, all groups at once."""
        n = len(self.fp)
        label = np.arange(n)
        top = self.levels[-1]
        root_of = np.searchsorted(top["group"], self.group)
        for c in range(0, n, chunk):
            q = np.arange(c, min(n, c + chunk))
            node, acc = root_of[q], np.zeros(len(q), np.int64)
            united = self._united(label)
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                acc = acc + np.bitwise_count((self.fp[q] ^ level["pattern"][node]) & level["own"][node])
                keep = (acc <= max_bits) & (united[depth][node] != label[q])
                q, node, acc = q[keep], node[keep], acc[keep]
                if depth:
                    kids = level["n"][node]
                    at = np.repeat(np.arange(len(q)), kids)
                    node = level["lo"][node][at] + np.arange(len(at)) - np.repeat(np.cumsum(kids) - kids, kids)
                    q, acc = q[at], acc[at]
            if len(q):
                label = self._merge(label, q, node)
        return label

    def _united(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level: the label that all leaves of a node share, else -1."""
        out = [label]
        for level in self.levels[1:]:
            low = np.minimum.reduceat(out[-1], level["lo"])
            out.append(np.where(low == np.maximum.reduceat(out[-1], level["lo"]), low, -1))
        return out

    @staticmethod
    def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return local_components(len(label), label[a], label[b])[label]


def _blocks(bits: range, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` blocks of a run of bits."""
    cuts = [bits.start + len(bits) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def near_links(fps: DataFrame, max_bits: int = 3, hot: int = 200_000) -> DataFrame:
    """Links (a, b) between the ``node`` numbers of distinct fingerprints (node, fp): enough of
    them to join all that are within ``max_bits`` of one another, directly or by steps."""
    fp = F.col("fp")
    tops = _blocks(range(64), max_bits + 1)

    def value(shift: int, width: int):
        return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))

    dealt = fps.select("node", fp, F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), value(*b).alias("val")) for i, b in enumerate(tops)])).alias("k")) \
        .select("node", "fp", "k.block", "k.val")
    crowd = F.broadcast(dealt.groupBy("block", "val").count().where(F.col("count") > hot)  # 4 N / hot rows at most
                        .select("block", "val", F.lit(True).alias("crowded")))
    inner = []  # blocks of the bits outside each top block
    for shift, width in tops:
        rest = [i for i in range(64) if not shift <= i < shift + width]
        inner.append([rest[a:a + w] for a, w in _blocks(range(len(rest)), max_bits + 1)])

    def gather(bits: list[int]):
        mask = sum(1 << b for b in bits)
        return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    again = F.lit(None)
    for i, sets in enumerate(inner):
        again = F.when(F.col("block") == i, F.array(*[
            F.struct(F.lit(j).alias("j"), gather(bits).alias("v")) for j, bits in enumerate(sets)])).otherwise(again)
    once = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("v")))
    dealt = (dealt.join(crowd, ["block", "val"], "left")
             .select("node", "fp", "block", "val", F.explode(F.when(F.col("crowded"), again).otherwise(once)).alias("s"))
             .select("node", "fp", "block", "val", "s.j", "s.v"))

    def search(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        node, fps_, *key = (t.column(i).to_numpy() for i in range(6))
        order = np.lexsort(key)
        step = np.zeros(len(order), bool)
        for k in key:
            step[1:] |= np.diff(k[order]) != 0
        group = np.cumsum(step)
        size = np.bincount(group)[group]
        order, group = order[size > 1], group[size > 1]
        if not len(order):
            return
        index = GrayIndex(group, fps_[order].view(np.uint64))
        label = index.linked(max_bits)
        far = np.flatnonzero(label != np.arange(len(label)))
        node = node[order][index.order]
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], names=["a", "b"])

    return arrow_map(dealt.repartition("block", "val", "j", "v"), search, "a long, b long")


UNNAMED = 1 << 62  # nodes from here on are fingerprints without any doc_id


def _groups_by_place(rows: DataFrame, max_bits: int, hot: int) -> DataFrame:
    first = cut_lineage(global_ordinal(rows.groupBy("fp").agg(F.min("doc_id").alias("low")),
                                       [F.col("low").asc_nulls_last(), F.col("fp")], "node"), "distinct-fingerprints")
    comp = components(near_links(first.select("node", "fp"), max_bits, hot), "a", "b")
    of = cut_lineage(first.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("top")), "tops")
    sizes = of.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
    named = cut_lineage(sizes.join(first.select(F.col("node").alias("top"), F.col("low").alias("component_id")), "top"), "named")
    of = join_sized(of, named, ["top"], "n").select("fp", "component_id")
    return rows.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_groups(docs: DataFrame, width: int = 3, max_bits: int = 3, hot: int = 200_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    A fingerprint's node is its smallest doc_id, so the smallest node of a component is the
    answer and no join by component is needed.  Where a doc_id is 2**62 or more, which leaves no
    numbers for fingerprints without an id, nodes are places in the order of the smallest doc_ids."""
    rows = cut_lineage(fingerprint_rows(docs, width), "fingerprints")
    if (rows.agg(F.max("doc_id")).first()[0] or 0) >= UNNAMED:
        return _groups_by_place(rows, max_bits, hot)
    unnamed = F.xxhash64("fp").bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))
    first = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
                        .select("fp", F.coalesce("low", unnamed).alias("node")), "distinct-fingerprints")
    comp = components(near_links(first, max_bits, hot), "a", "b")
    lowest = F.coalesce("component", "node")
    of = first.join(comp, "node", "left").select("fp", F.when(lowest < UNNAMED, lowest).alias("component_id"))
    return rows.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
