"""Prefix trie of rebuilt conversations as minimal-perfect-hash node tables.

A node is a distinct sequence of first turns.  Its digest (128 bits) is the XOR of the digests of
(turn, depth) along the way.  A task holds a shard: up to some 200,000 turns of whole pieces, a
piece being 1,024 turns of one conversation.  It enumerates the shard's distinct digests, gives each
a slot by a minimal perfect hash whose table keeps the digest itself (so a wrong slot is seen),
scatters counts into flat arrays and adds them up through the parent slots, deepest first.  Shards
hold parts of the same nodes; the parts are added up by digest, where depth, parent and last turn
must agree (else the digests are seeded anew).

Sums over a subtree must count a node once, whichever shards hold it: its smallest member owns it.
A second pass scatters what each conversation owns and adds it up in the same way; what deeper
pieces of the conversation own enters at the end of the piece.

Defined cases: null role and text are empty; turns with one number are ordered by a digest of role
and text; rows that repeat are turns of their own.  Rows with a null conv_id are one conversation
without a number: it is not rebuilt, is never the smallest member beside another, and comes last,
as an empty string, among a node's ends.  ``conv_id % 5`` has the sign of conv_id.  An empty table
gives no rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rowindex import places
from ..session import cut_lineage
from .common import ODD, arrow_map, join_sized, mix

BAND_BITS = 10        # turns of a piece: 1,024
SHARD_ROWS = 200_000  # rows that a task holds at once
NO_ID = np.iinfo(np.int64).max


# ---------------------------------------------------------------- node table
class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests: in every level a key that is alone in its
    cell is placed, the others go on; the slot is the number of filled cells before it."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, self.size = [], len(a)
        self.a, self.b = np.empty(len(a), np.uint64), np.empty(len(a), np.uint64)
        left, base = np.arange(len(a)), 0
        while len(left):
            cells = 2 * len(left) + 1
            at = self._cell(a[left], b[left], len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            rank = np.where(alone, np.cumsum(alone) - 1 + base, -1)
            self.levels.append(rank)
            placed = rank[at] >= 0
            self.a[rank[at[placed]]], self.b[rank[at[placed]]] = a[left[placed]], b[left[placed]]
            base += int(alone.sum())
            left = left[~placed]
            if len(self.levels) > 200:
                raise RuntimeError("digests given to a slot table must be distinct")

    @staticmethod
    def _cell(a, b, level, cells):
        with np.errstate(over="ignore"):
            return (mix(mix(a + np.uint64(level) * ODD) ^ b) % np.uint64(cells)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of every digest; a digest that the table does not hold has -1."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, rank in enumerate(self.levels):
            at = rank[self._cell(a[left], b[left], level, len(rank))]
            out[left[at >= 0]] = at[at >= 0]
            left = left[at < 0]
            if not len(left):
                break
        wrong = (out >= 0) & ((self.a[out] != a) | (self.b[out] != b))
        out[wrong] = -1
        return out


def turn_digests(turn: np.ndarray, depth: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of (turn, depth) from the turns' 128-bit ones."""
    with np.errstate(over="ignore"):
        d = depth.astype(np.uint64) * ODD + np.uint64(seed)
        return mix(turn[:, 0] + mix(turn[:, 1] ^ d)), mix(turn[:, 1] + mix(turn[:, 0] ^ ~d))


class Shard:
    """Trie of the pieces in ``rows`` (dict of arrays sorted by conv, band, depth, kind).  Kinds: 0 digest
    of the turns before the piece (x, y), 1 turn, 2 what the conversation owns at a depth (x, y),
    3 what its deeper pieces own."""

    def __init__(self, rows: dict, seed: int):
        self.rows = rows
        conv, null, band, kind = rows["conv"], rows["null"], rows["band"], rows["kind"]
        new = np.ones(len(conv), bool)
        new[1:] = (conv[1:] != conv[:-1]) | (null[1:] != null[:-1]) | (band[1:] != band[:-1])
        piece = np.cumsum(new) - 1
        self.t = t = np.flatnonzero(kind == 1)
        of = piece[t]
        self.depth = rows["depth"][t]
        g = turn_digests(rows["turn"][t], self.depth, seed)
        first = np.ones(len(t), bool)
        first[1:] = of[1:] != of[:-1]
        start = np.flatnonzero(first)[np.cumsum(first) - 1] if len(t) else t
        self.d, self.up = [], []
        for lane, x in zip(g, ("x", "y")):
            run = np.bitwise_xor.accumulate(lane) if len(t) else lane
            before = np.zeros(piece[-1] + 1 if len(piece) else 0, np.uint64)
            before[piece[kind == 0]] = rows[x][kind == 0].view(np.uint64)
            mine = run ^ np.where(start > 0, run[start - 1], np.uint64(0)) ^ before[of] if len(t) else run
            self.d.append(mine)
            self.up.append(mine ^ lane)
        self.last = np.ones(len(t), bool)
        self.last[:-1] = first[1:]
        a, b = self.d
        order = np.lexsort((b, a))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.table = SlotTable(a[order][fresh], b[order][fresh])
        self.slot = self.table.slots(a, b)
        previous = np.empty(len(t), np.int64)
        previous[1:], previous[first] = self.slot[:-1], -1
        self.parent = np.full(self.table.size, -1)
        self.parent[self.slot] = previous
        self.row = np.zeros(self.table.size, np.int64)  # a row of each node
        self.row[self.slot] = np.arange(len(t))
        same = [self.depth, *self.up, rows["turn"][t][:, 0], rows["turn"][t][:, 1], previous]
        self.sound = bool((self.slot >= 0).all()) and all((c == c[self.row[self.slot]]).all() for c in same)
        self.levels = np.argsort(-self.depth[self.row], kind="stable")

    def add_up(self, values: np.ndarray, join) -> None:
        """Bring every node's value to its parent, deepest first."""
        depth = self.depth[self.row][self.levels]
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for nodes in np.split(self.levels, cuts):
            nodes = nodes[self.parent[nodes] >= 0]
            join.at(values, self.parent[nodes], values[nodes])

    def members(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per slot: conversations, of these without an id, smallest id."""
        rows, at = self.t[self.last], self.slot[self.last]
        n, nulls = np.zeros(self.table.size, np.int64), np.zeros(self.table.size, np.int64)
        low = np.full(self.table.size, NO_ID)
        null = self.rows["null"][rows]
        np.add.at(n, at, 1)
        np.add.at(nulls, at, null.astype(np.int64))
        np.minimum.at(low, at[~null], self.rows["conv"][rows][~null])
        self.add_up(n, np.add)
        self.add_up(nulls, np.add)
        self.add_up(low, np.minimum)
        return n, nulls, low

    def owned(self) -> tuple[np.ndarray, np.ndarray]:
        """Per slot the sums of what is owned in its subtree."""
        mine = np.flatnonzero(self.rows["kind"] >= 2)
        at = self.slot[np.searchsorted(self.t, mine) - 1]
        out = []
        for x in ("x", "y"):
            v = np.zeros(self.table.size, np.int64)
            np.add.at(v, at, self.rows[x][mine])
            self.add_up(v, np.add)
            out.append(v)
        return tuple(out)


COLUMNS = ["conv", "band", "depth", "kind", "turn", "n_bytes", "end", "x", "y"]


def _arrays(batch: pa.RecordBatch) -> dict:
    def numbers(name):
        return batch.column(COLUMNS.index(name)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    conv = batch.column(0)
    turns = batch.column(4).fill_null(b"\0" * 16).cast(pa.binary(16))
    buf = np.frombuffer(turns.buffers()[1], np.uint64)[2 * turns.offset:2 * (turns.offset + len(turns))].reshape(-1, 2)
    return {"conv": numbers("conv"), "null": conv.is_null().to_numpy(zero_copy_only=False), "turn": buf,
            "end": batch.column(6).fill_null(False).to_numpy(zero_copy_only=False),
            **{c: numbers(c) for c in ("band", "depth", "kind", "n_bytes", "x", "y")}}


def _shards(batches, seed: int):
    """Shards of whole pieces, in the order of the rows."""
    held, size = [], 0

    def joined():
        return {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_arrays(batch))
        size += batch.num_rows
        if size >= SHARD_ROWS:
            rows = joined()
            key = [rows[k] for k in ("conv", "null", "band")]
            same = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
            cut = int(same[-1]) + 1 if len(same) else 0
            if cut:
                yield Shard({k: v[:cut] for k, v in rows.items()}, seed)
            held = [{k: v[cut:] for k, v in rows.items()}]
            size -= cut
    if size:
        yield Shard(joined(), seed)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


NODES = "a long, b long, depth long, up_a long, up_b long, turn_a long, turn_b long, n_bytes long, n long, nulls long, low long, sound boolean, is_end boolean"


def _node_parts(seed: int):
    names = [x.split(" ")[0] for x in NODES.split(", ")]

    def run(batches):
        for s in _shards(batches, seed):
            n, nulls, low = s.members()
            at = s.row
            turn = s.rows["turn"][s.t][at].view(np.int64)
            yield _batch(names, s.table.a.view(np.int64), s.table.b.view(np.int64), s.depth[at], *[u[at].view(np.int64) for u in s.up],
                         turn[:, 0].copy(), turn[:, 1].copy(), s.rows["n_bytes"][s.t][at], n, nulls, pa.array(low, mask=n == nulls),
                         np.full(len(n), s.sound), np.zeros(len(n), bool))
            end = np.flatnonzero(s.rows["end"][s.t])
            zero, rows = np.zeros(len(end), np.int64), s.t[end]
            yield _batch(names, *[d[end].view(np.int64) for d in s.d], zero, zero, zero, zero, zero, zero, zero, zero,
                         pa.array(s.rows["conv"][rows], mask=s.rows["null"][rows]), np.ones(len(end), bool), np.ones(len(end), bool))
    return run


def _owned_parts(seed: int):
    def run(batches):
        for s in _shards(batches, seed):
            x, y = s.owned()
            some = (x != 0) | (y != 0)
            yield _batch(["a", "b", "x", "y"], s.table.a[some].view(np.int64), s.table.b[some].view(np.int64), x[some], y[some])
    return run


def _piece_digests(seed: int):
    """Digest of each piece, in parts."""
    def run(batches):
        for batch in batches:
            r = _arrays(batch)
            x, y = turn_digests(r["turn"], r["depth"], seed)
            yield _batch(["conv", "band", "x", "y"], pa.array(r["conv"], mask=r["null"]), r["band"], x.view(np.int64), y.view(np.int64))
    return run


ENDS = 10_000  # ids of a node that travel together


def _end_texts(batches):
    """(a, b, first, text) from (a, b, conv) sorted: runs of ids of one node as text."""
    names, key, ids, out = ["a", "b", "first", "text"], None, [], []

    def flush():
        if ids:
            out.append((*key, ids[0], ",".join("" if i is None else str(i) for i in ids)))

    for batch in batches:
        for a, b, conv in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if (a, b) != key or len(ids) >= ENDS:
                flush()
                key, ids = (a, b), []
            ids.append(conv)
        if len(out) > 10_000:
            yield _batch(names, *[pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])])
            out = []
    flush()
    if out:
        yield _batch(names, *[pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])])


def _end_digests(batches):
    """(a, b, sha) from (a, b, text) sorted; one text is held at a time."""
    names, key, sha, out = ["a", "b", "sha"], None, None, []
    for batch in batches:
        for a, b, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
            if (a, b) != key:
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        if len(out) > 10_000:
            yield _batch(names, *zip(*out))
            out = []
    if key:
        out.append((*key, sha.hexdigest()))
    if out:
        yield _batch(names, *zip(*out))


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, sha) of (a, b, conv): SHA-256 of the ids of a node, ascending.  The ids are sorted across the
    cluster and put into texts there; the digest itself can only be taken in order."""
    order = ["a", "b", F.col("conv").asc_nulls_last()]
    texts = arrow_map(ends.repartitionByRange(*order).sortWithinPartitions(*order), _end_texts, "a long, b long, first long, text string")
    dealt = texts.repartition("a", "b").sortWithinPartitions("a", "b", F.col("first").asc_nulls_last())
    return arrow_map(dealt, _end_digests, "a long, b long, sha string")


# ---------------------------------------------------------------- rebuilt conversations
def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): ``turns`` has conv, depth, band, turn (digest of role and text), n_bytes,
    end, long (the conversation has several pieces); ``conversations`` has conv and its length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").alias("at"), turn.alias("turn"),
                                F.octet_length(text).cast("long").alias("n_bytes"))
    placed = cut_lineage(places(rows, ["conv"], [F.col("at").asc_nulls_first(), F.col("turn")], "pos").drop("at"), "placed")
    own = F.col("conv")
    convs = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "n", F.when(own.isNull(), 0).otherwise(F.crc32(own.cast("string")) % 9).alias("h"), (own - F.expr("conv % 5")).alias("base"))
    sizes = convs.select(own.alias("base"), F.col("n").alias("n_base"))
    convs = cut_lineage(convs.join(sizes, "base", "left")
                        .withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
                        .withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    long = (F.col("length") > 1 << BAND_BITS).alias("long")
    tail = join_sized(placed, convs, ["conv"], "n").where("pos >= h").select(
        "conv", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "turn", "n_bytes",
        (F.col("pos") == F.col("n") - 1).alias("end"), long)
    head = placed.where("pos < 8").withColumnRenamed("conv", "base").join(convs, "base").where("pos < h").select(
        "conv", (F.col("pos") + 1).alias("depth"), "turn", "n_bytes",
        ((F.col("n") <= F.col("h")) & (F.col("pos") == F.col("k") - 1)).alias("end"), long)
    band = F.shiftright(F.col("depth") - 1, BAND_BITS)
    return cut_lineage(tail.unionByName(head).withColumn("band", band), "rebuilt"), convs


def _pieces(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS).repartition("conv", "band").sortWithinPartitions("conv", "band", "depth", "kind")


def _marks(df: DataFrame, kind: int, x: str, y: str, depth) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    return df.select("conv", "band", depth.alias("depth"), F.lit(kind).alias("kind"), null("binary").alias("turn"),
                     null("long").alias("n_bytes"), null("boolean").alias("end"), F.col(x).alias("x"), F.col(y).alias("y"))


def _before(turns: DataFrame, seed: int) -> DataFrame:
    """Digest of all turns before a piece, for pieces after the first (kind 0)."""
    parts = arrow_map(turns.where("long").select(*COLUMNS), _piece_digests(seed), "conv long, band long, x long, y long")
    w = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
    sums = parts.groupBy("conv", "band").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    sums = sums.select("conv", "band", F.bit_xor("x").over(w).alias("x"), F.bit_xor("y").over(w).alias("y")).where("band > 0")
    return _marks(sums, 0, "x", "y", F.shiftleft("band", BAND_BITS))


def _deeper(turns: DataFrame, owners: DataFrame) -> DataFrame:
    """What the deeper pieces of a conversation own, for pieces before the last (kind 3)."""
    width = 1 << BAND_BITS
    zero = F.lit(0).cast("long")
    pieces = turns.where((F.col("band") > 0) & ((F.col("depth") - 1) % width == 0)).select(
        "conv", (F.col("band") - 1).alias("band"), zero.alias("x"), zero.alias("y"), F.lit(True).alias("wanted"))
    sums = owners.where("band > 0").groupBy("conv", "band").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).withColumn("wanted", F.lit(False))
    w = Window.partitionBy("conv").orderBy(F.col("band").desc()).rangeBetween(Window.unboundedPreceding, -1)  # a row per piece
    sums = pieces.unionByName(sums).select("conv", "band", "wanted", F.sum("x").over(w).alias("x"), F.sum("y").over(w).alias("y"))
    return _marks(sums.where("wanted and x is not null"), 3, "x", "y", F.shiftleft(F.col("band") + 1, BAND_BITS) + 1)


def _nodes(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """Node table, ends, and whether no two nodes share a digest."""
    parts = cut_lineage(arrow_map(_pieces(rows), _node_parts(seed), NODES), "node-parts")
    same = ["depth", "up_a", "up_b", "turn_a", "turn_b"]
    nodes = parts.where("not is_end").groupBy("a", "b").agg(
        *[F.min(c).alias(c) for c in same], F.min("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.min("low").alias("low"),
        F.bool_and("sound").alias("sound"), *[F.max(c).alias(f"max_{c}") for c in same])
    agree = F.col("sound")
    for c in same:
        agree = agree & (F.col(c) == F.col(f"max_{c}"))
    nodes = cut_lineage(nodes.select("a", "b", "depth", "up_a", "up_b", "n_bytes", "n", "low", agree.alias("agree")), "nodes")
    return nodes, parts.where("is_end").select("a", "b", F.col("low").alias("conv")), nodes.where("not agree").isEmpty()


def trie(conversations: DataFrame, seeds: tuple = (1, 2, 3)) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations)
    longest = convs.agg(F.max("length")).first()[0] or 0
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    turns = turns.select("*", F.lit(1).alias("kind"), null.alias("x"), null.alias("y"))
    for seed in seeds:
        rows = turns.select(*COLUMNS)
        if longest > 1 << BAND_BITS:
            rows = rows.unionByName(_before(turns, seed))
        nodes, ends, sound = _nodes(rows, seed)
        if sound:
            break
    else:
        raise RuntimeError("digests collide under every seed")
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("low")).where("n > 0").select(
        zero.alias("a"), zero.alias("b"), zero.alias("depth"), null.alias("up_a"), null.alias("up_b"), zero.alias("n_bytes"), "n", "low")
    nodes = nodes.drop("agree").unionByName(root)
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, ["a", "b"], "left"), "nodes")
    owners = nodes.select(F.col("low").alias("conv"), F.shiftright(F.col("depth") - 1, BAND_BITS).alias("band"), "depth",
                          ((F.col("n") - 1) * F.col("n_bytes")).alias("x"), F.col("n_children").isNull().cast("long").alias("y"))
    owned = _marks(owners.where("depth > 0 and (x <> 0 or y <> 0)"), 2, "x", "y", F.col("depth"))
    rows = rows.unionByName(owned)
    if longest > 1 << BAND_BITS:
        rows = rows.unionByName(_deeper(turns, owned))
    sums = arrow_map(_pieces(rows), _owned_parts(seed), "a long, b long, x long, y long")
    sums = sums.groupBy("a", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sums = sums.unionByName(owners.agg(F.sum("x").alias("x"), F.sum("y").alias("y")).select(zero.alias("a"), zero.alias("b"), "x", "y"))
    ends = ends.unionByName(convs.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv"))
    whole = cut_lineage(nodes.join(sums, ["a", "b"], "left").join(end_digests(ends), ["a", "b"], "left"), "whole")
    parents = nodes.where("n_children is not null").select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("low").alias("parent"),
                                                           F.col("n_children").alias("n_siblings"))
    return join_sized(whole, parents, ["up_a", "up_b"], "n_siblings").select(
        F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"), F.coalesce("y", zero).alias("n_leaves"),
        F.coalesce("x", zero).alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
