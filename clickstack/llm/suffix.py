"""Exact-repeat removal: every byte covered by a ``width``-byte string that also starts
earlier (smaller doc_id, or the same document and an earlier start) goes.

All suffixes of a large corpus cannot be shuffled, so a sparse suffix array is sorted.
1. Sampling.  In each run of ``width - key + 1`` neighbouring ``key``-byte grams the one
   with the smallest hash (the rightmost if tied) is an anchor.  Equal ``width``-byte
   strings have their anchor at the same place, so no repeat is missed.  An anchor's
   context is all bytes that a ``width``-byte string around it can reach.
2. Anchors meet by gram hash.  Where a whole context occurred before, all its strings did:
   the context goes.  Each task first merges equal contexts of its own rows, so a passage
   that a third of the corpus holds reaches the shuffle a few times only.
3. Anchors whose contexts differ (the borders of copies) are looked at byte by byte: the
   suffixes at the anchors, and the reversed text before them, are ordered by deep-shallow
   sorting: multikey quicksort to ``SHALLOW`` bytes, then blind tries for suffixes that
   still agree.  The common prefixes of neighbours give, for every placing of a string
   around the anchor, which ones are equal and which of them is first.  For this the
   anchors meet by gram and half of the reachable bytes on one side, so that a short
   line in very different surroundings makes no large group.

Defined cases: null text is empty; every row is a document of its own, a null doc_id sorts
last, rows that share a doc_id follow each other in a fixed order; extra columns are ignored; an
empty table gives an empty result.  Context equality in step 2 rests on 64-bit hashes within one 64-bit
gram hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import cut_lineage
from .common import arrow_map, mix, prefix_sums, row_keys, span_hash, text_slices

SHALLOW = 32  # bytes compared by the quicksort before a blind trie takes over
RUN = 1 << 20  # bytes handled at once; a longer text is taken in overlapping runs


def _anchors(data: np.ndarray, ends: np.ndarray, width: int, key: int):
    """Anchor places and gram hashes in ``data``; texts end at ``ends``."""
    n, w = len(data), width - key + 1
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = prefix_sums(data)
    at = np.arange(n - key + 1)
    gram = span_hash(sums, at, at + key)
    low = np.uint64((1 << 22) - 1)  # the place, counted down: the rightmost of equal hashes is least
    best = (gram & ~low) | (low - at.astype(np.uint64))
    span = 1
    while span * 2 <= w:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < w:
        best = np.minimum(best[:n - width + 1], best[w - span:])
    closed = np.zeros(n + 1, np.int32)  # string starts that would cross a text's end
    np.add.at(closed, np.maximum(ends - width + 1, np.concatenate([[0], ends[:-1]])), 1)
    np.add.at(closed, ends, -1)
    place = (low - (best & low)).astype(np.int64)[np.cumsum(closed[:n - width + 1]) == 0]
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    return place, gram[place]


def sampled(data: np.ndarray, offs: np.ndarray, width: int, key: int):
    """(text index, place in text, bytes left, bytes right, gram hash, context hash)."""
    reach = width - key

    def part(data, offs):
        place, gram = _anchors(data, offs[1:], width, key)
        text = np.searchsorted(offs, place, "right") - 1
        lo, hi = np.maximum(offs[text], place - reach), np.minimum(offs[text + 1], place + width)
        left, right = place - lo, hi - place
        context = mix(span_hash(prefix_sums(data), lo, hi) + (left * 4096 + right).astype(np.uint64))
        return text, place - offs[text], left, right, gram, context

    if len(data) <= 2 * RUN:
        return part(data, offs)
    out = []  # one long text: the runs share enough bytes for every string and every context
    for s in range(0, len(data), RUN):
        lo, hi = max(0, s - reach), min(len(data), s + RUN + 2 * width)
        text, place, left, right, gram, context = part(data[lo:hi], np.array([0, hi - lo]))
        own = (place + lo >= s) & (place + lo < s + RUN)
        out.append([x[own] for x in (text, place + lo, left, right, gram, context)])
    return [np.concatenate(c) for c in zip(*out)]


def _merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Union of the spans of each document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    number = np.cumsum(new)
    base = number * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + base)  # documents ascend, so no span reaches into the next
    head = new.copy()
    head[1:] |= (lo + base)[1:] > reach[:-1]
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], lo[at], (reach - base)[last]


def _first_of(gram, context, doc, place):
    """Order by context; is a row its context's first; is it there again (the same place)."""
    order = np.lexsort((place, doc, context, gram))
    g, c, d, p = gram[order], context[order], doc[order], place[order]
    head = np.ones(len(order), bool)
    head[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    same = np.zeros(len(order), bool)
    same[1:] = ~head[1:] & (d[1:] == d[:-1]) & (p[1:] == p[:-1])
    start = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    again = ~head & ((d != d[start]) | (p != p[start]))
    return order, head, again & ~same


ANCHOR = "gram long, context long, doc long, place long, left long, right long"


def _rows(names, *arrays):
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))
                                       for a in arrays], names=names)


_NAMES = ["gram", "context", "doc", "place", "left", "right"]


def anchor_rows(docs: DataFrame, width: int, key: int) -> DataFrame:
    """Anchors of (doc, text); spans already known to go have ``left`` -1 and end at ``right``."""
    def run(batches):
        for batch in batches:
            got = []
            for rows, data, offs in text_slices([batch], ["doc"], "text", RUN):
                text, *rest = sampled(data, offs, width, key)
                got.append([rows.column(0).to_numpy()[text], *rest])
            if not got:
                continue
            doc, place, left, right, gram, context = (np.concatenate(c) for c in zip(*got))
            order, head, again = _first_of(gram, context, doc, place)
            a, h = order[again], order[head]
            yield _rows(_NAMES, gram[h], context[h], doc[h], place[h], left[h], right[h])
            d, lo, hi = _merge(doc[a], place[a] - left[a], place[a] + right[a])
            yield _rows(_NAMES, mix(d.view(np.uint64)), np.zeros(len(d), np.int64), d, lo, np.full(len(d), -1), hi)

    return arrow_map(docs, run, ANCHOR)


def meet(anchors: DataFrame) -> DataFrame:
    """Spans that go (``left`` -1) and border anchors (those with several contexts)."""
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        gram, context, doc, place, left, right = (t.column(i).to_numpy() for i in range(6))
        span = left == -1
        yield _rows(_NAMES, gram[span], context[span], doc[span], place[span], left[span], right[span])
        gram, context, doc, place, left, right = (c[~span] for c in (gram, context, doc, place, left, right))
        order, head, again = _first_of(gram, context, doc, place)
        a, h = order[again], order[head]
        d, lo, hi = _merge(doc[a], place[a] - left[a], place[a] + right[a])
        yield _rows(_NAMES, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, lo, np.full(len(d), -1), hi)
        g = gram[h]
        mixed = np.zeros(len(h), bool)
        if len(h):
            mixed[1:] |= g[1:] == g[:-1]
            mixed[:-1] |= g[1:] == g[:-1]
        h = h[mixed]
        yield _rows(_NAMES, gram[h], context[h], doc[h], place[h], left[h], right[h])

    return arrow_map(anchors.repartition("gram"), run, ANCHOR)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Order of ``members`` and the common prefix of each with the one before.  A node keeps a
    depth and its branches by the byte there (-1: ended); strings meet only at leaves."""
    root: list = [members[0]]
    for m in members[1:]:
        s, node = strings[m], root
        while isinstance(node, tuple):
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        leaf = strings[node[0]]
        depth = _common(s, leaf)
        if depth == len(s) == len(leaf):
            node.append(m)
            continue
        up, node = None, root
        while isinstance(node, tuple) and node[0] < depth:
            up, branch = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][branch]
        here = s[depth] if depth < len(s) else -1
        if isinstance(node, tuple) and node[0] == depth:
            node[1][here] = [m]
            continue
        fork = (depth, {(leaf[depth] if depth < len(leaf) else -1): node, here: [m]})
        if up is None:
            root = fork
        else:
            up[1][branch] = fork
    order, lcp, todo = [], [], [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if isinstance(node, tuple):
            kids = sorted(node[1])
            for i in range(len(kids) - 1, -1, -1):
                todo.append((node[1][kids[i]], node[0] if i else shared))
        else:
            n = len(strings[node[0]])
            order += node
            lcp += [shared] + [n] * (len(node) - 1)
    return order, lcp


def deep_shallow(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Sorted ``members`` and the common prefix of each with the one before it (0 first)."""
    order, todo = [], [(members, 0, 0)]
    lcp: list[int] = []
    while todo:  # (strings equal before depth, depth, common prefix with what stands before)
        group, depth, shared = todo.pop()
        if len(group) == 1:
            order += group
            lcp.append(shared)
        elif depth >= SHALLOW or len(group) <= 4:
            o, c = blind_trie(strings, group)
            order += o
            lcp += [shared] + c[1:]
        else:
            keys = [strings[m][depth:depth + 8] for m in group]
            pivot = sorted(keys[::max(1, len(keys) // 9)])[min(len(keys), 9) // 2]
            low = [m for m, k in zip(group, keys) if k < pivot]
            high = [m for m, k in zip(group, keys) if k > pivot]
            equal = [m for m, k in zip(group, keys) if k == pivot]
            if len(pivot) < 8:  # these end here and are equal
                parts = [(low, depth), (equal, SHALLOW), (high, depth)]
            else:
                parts = [(low, depth), (equal, depth + 8), (high, depth)]
            parts = [p for p in parts if p[0]]
            for i in range(len(parts) - 1, -1, -1):
                todo.append((*parts[i], shared if i == 0 else -1))
    for i, c in enumerate(lcp):
        if c == -1:
            lcp[i] = _common(strings[order[i - 1]], strings[order[i]])
    return order, lcp


def _classes(strings: list[bytes], groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    order, lcp = [], []
    for g in groups:
        o, c = deep_shallow(strings, g)
        order += o
        lcp += [-1] + c[1:]
    return np.array(order, np.int64), np.array(lcp, np.int64)


def border_spans(group: np.ndarray, before: list[bytes], after: list[bytes], side: np.ndarray, doc: np.ndarray,
                 place: np.ndarray, width: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the anchors' strings that start earlier elsewhere.  ``after``: bytes from the
    anchor on; ``before``: those before it, reversed; ``side`` 1 looks at strings with half
    of the reachable bytes on the left, 0 at the others."""
    reach = width - key
    half = (reach + 1) // 2
    n = len(group)
    by = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[by])) + 1
    groups = [g.tolist() for g in np.split(by, cuts) if len(g) > 1]
    if not groups:
        return doc[:0], place[:0], place[:0]
    order_r, lcp_r = _classes(after, groups)
    order_l, lcp_l = _classes(before, groups)
    len_l = np.array([len(b) for b in before])
    len_r = np.array([len(a) for a in after])
    rank = np.empty(n, np.int64)
    rank[np.lexsort((place, doc))] = np.arange(n)
    same = np.lexsort((place, doc, group))
    twin = np.zeros(n, bool)  # the same place again: no earlier one
    twin[same[1:]] = np.all([c[same][1:] == c[same][:-1] for c in (group, doc, place)], axis=0)
    goes = np.zeros((n, reach + 2), bool)
    cl_r, cl_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(reach + 1):  # bytes of the string before the anchor
        fits = order_r[(len_l[order_r] >= o) & (len_r[order_r] >= width - o) & (side[order_r] == (o >= half))
                       & ~twin[order_r]]
        if len(fits) < 2:
            continue
        cl_r[order_r] = np.cumsum(lcp_r < width - o)
        cl_l[order_l] = np.cumsum(lcp_l < o)
        code = cl_r[fits] * (n + 1) + cl_l[fits]
        s = np.lexsort((rank[fits], code))
        later = np.concatenate([[False], code[s][1:] == code[s][:-1]])
        goes[fits[s[later]], o + 1] = True
    row, step = np.nonzero(np.diff(goes.astype(np.int8), axis=1, append=0))
    # steps alternate: a run of placings begins, a run ends
    first, last = step[::2], step[1::2] - 1
    row = row[::2]
    return doc[row], place[row] - last, place[row] - first + width


def border(texts: DataFrame, met: DataFrame, width: int, key: int) -> DataFrame:
    """Spans (doc, lo, hi) found at the border anchors of ``met``."""
    reach = width - key
    half = (reach + 1) // 2
    per_doc = (met.where(F.col("left") >= 0).groupBy("doc")
               .agg(F.collect_list(F.struct("gram", "place", "left", "right")).alias("anchors")))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            docs, texts, anchors = (batch.column(batch.schema.get_field_index(c)) for c in ("doc", "text", "anchors"))
            docs = docs.to_pylist()
            for i in np.flatnonzero(anchors.is_valid().to_numpy(zero_copy_only=False)):
                data = (texts[i].as_py() or "").encode()
                for a in {tuple(x.values()) for x in anchors[i].as_py()}:
                    gram, p, left, right = a
                    b, f = data[p - left:p][::-1], data[p:p + right]
                    for side, enough in ((1, left >= half), (0, right >= key + reach - half + 1)):
                        if enough:
                            near = b[:half] if side else f[key:key + reach - half + 1]
                            for col, v in zip(out, (gram, near, side, docs[i], p, b, f)):
                                col.append(v)
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             names=["gram", "near", "side", "doc", "place", "before", "after"])

    def solve(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        ids: dict = {}
        group = np.array([ids.setdefault(k, len(ids)) for k in zip(*(t.column(i).to_pylist() for i in (0, 1, 2)))], np.int64)
        side, doc, place = (t.column(i).to_numpy() for i in (2, 3, 4))
        doc, lo, hi = _merge(*border_spans(group, t.column(5).to_pylist(), t.column(6).to_pylist(), side, doc, place, width, key))
        yield _rows(["doc", "lo", "hi"], doc, lo, hi)

    # a left join, as in kept_texts, so that both read one shuffle of the texts
    found = arrow_map(texts.join(per_doc, "doc", "left"), cut, "gram long, near binary, side long, doc long, place long, "
                      "before binary, after binary")
    return arrow_map(found.repartition("gram", "near", "side"), solve, "doc long, lo long, hi long")


def _outward(data: bytes, lo: list[int], hi: list[int]) -> None:
    """Move the ends of spans that cut a character in two past its bytes."""
    for k, (a, b) in enumerate(zip(lo, hi)):
        while 0 < a < len(data) and data[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        lo[k], hi[k] = a, b


def _kept(texts: DataFrame, width: int, key: int, whole: bool = False) -> DataFrame:
    """``texts`` (doc, text and other columns) with ``kept`` and ``spans``.  With ``whole``, the bytes of a
    character that was cut in two do not stay in ``kept``."""
    met = cut_lineage(meet(anchor_rows(texts, width, key)), "anchors")
    known = met.where(F.col("left") == -1).select("doc", F.col("place").alias("lo"), F.col("right").alias("hi"))
    spans = (known.unionByName(border(texts, met, width, key)).groupBy("doc")
             .agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    joined = texts.join(spans, "doc", "left")
    at = joined.columns.index("text"), joined.columns.index("spans")
    span_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def cut(batches):
        for batch in batches:
            kept, runs = [], []
            for text, found in zip(batch.column(at[0]), batch.column(at[1])):
                data = (text.as_py() or "").encode()
                if found.is_valid:
                    flat = found.values
                    lo, hi = (np.minimum(flat.field(i).to_numpy(), len(data)) for i in (0, 1))
                    _, lo, hi = _merge(np.zeros(len(lo), np.int64), lo, hi)
                    lo, hi = lo.tolist(), hi.tolist()
                    runs.append([{"lo": a, "hi": b} for a, b in zip(lo, hi)])
                    if whole:
                        _outward(data, lo, hi)
                    data = b"".join(data[a:b] for a, b in zip([0, *hi], [*lo, len(data)]))
                else:
                    runs.append([])
                kept.append(data)
            cols = list(batch.columns)
            cols[at[1]] = pa.array(runs, span_type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary())], names=[*batch.schema.names, "kept"])

    return arrow_map(joined, cut, StructType([*joined.schema.fields, StructField("kept", BinaryType())]))


def kept_texts(docs: DataFrame, width: int = 100, key: int = 48) -> DataFrame:
    """(doc_id, text, kept binary, spans array<struct<lo, hi>>): what stays of each row and the
    maximal removed runs, in bytes."""
    rows = row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return _kept(rows, width, key).select("doc_id", "text", "kept", "spans")


def without_repeats(docs: DataFrame, width: int = 100, key: int = 48) -> DataFrame:
    """``docs`` with the repeats cut from ``text`` (and ``n_chars`` set anew, if it is there).  Bytes
    of a character that was cut in two go with it; null texts stay null."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    out = _kept(row_keys(rows), width, key, whole=True)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.decode("kept", "UTF-8"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*").select(docs.columns)
