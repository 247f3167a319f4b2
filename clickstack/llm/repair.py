"""Conversation structure repair by the auction shortest-path algorithm.

The turns of a conversation span a lattice of nodes (turn, state), whose states say what the roles
so far end in: nothing, system, user, assistant.  Arcs keep, rerole or delete a turn or insert an
empty one, at integer costs.  A path grows from the start node by node; a node's price rises to the
least cost-plus-price of its arcs when no arc is tight, and the path contracts.  When the path
reaches the end, prices are an optimal dual: every arc of every cheapest path is tight, so the
cheapest edits with the least initials are read off the tight arcs in letter order.

On Spark: damaged turns are reduced to 16 symbols, sorted across the cluster, and cut into segments
of at most 512 turns, whatever conversation they belong to.  Where a conversation spans segments,
the cost from each entry to each exit state of a segment is found by auctions, costs are combined
over blocks of segments up and down a tree, and each segment is then solved with known exit prices
and entry state.  Texts move once, to be hashed in order in a stream that holds one row.

Defined cases: null text, role and id count as one space where they are read, so a null text is
blank and a null role fits no pattern; rows with a null conv_id are one conversation.  Turns with
one number are ordered by a digest of role and text; repeated rows stay next to each other.  A
conversation without turns after damage costs nothing.  An empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rowindex import places
from ..session import cut_lineage
from .common import arrow_map, join_sized

BLANKS = " \t\n\x0b\f\r"  # fixed values: white space
SEGMENT_BITS = 9          # turns of a segment: 512
FAN = 1024                # segments of a block
INF = 1 << 40

# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
ADDED = (2, 2, 3, 2)                                        # state after an inserted or reroled turn
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})             # state after a kept system, user, assistant, other turn
CLOSE = (0, 4, 2, 0)                                        # cost of the turns missing at the end
CLOSING = ("", "II", "I", "")
ROLE = ("", "", "user", "assistant")                        # role of an added turn, by the state after it


def _arcs(symbol: int) -> list[list[tuple[str, int, int]]]:
    """Per state the arcs (initial, cost, next state) that consume a turn, in letter order."""
    kind, must, cut = symbol & 3, symbol >> 2 & 1, symbol >> 3 & 1
    out = []
    for q in range(4):
        arcs = [("D", 3, q)]
        if not must:
            if q in KEPT[kind]:
                arcs.append(("K", cut, KEPT[kind][q]))
            arcs.append(("R", 2 + cut, ADDED[q]))
        out.append(arcs)
    return out


ARCS = [_arcs(s) for s in range(16)]


class Auction:
    """Lattice over ``symbols`` with a cost for leaving in each state; prices stay between calls."""

    def __init__(self, symbols: bytes, leave: tuple):
        self.symbols, self.leave, n = symbols, leave, len(symbols)
        # feasible first prices: what the turns from here on cost at least
        least = min(leave)
        self.price = [0] * (4 * n + 4)
        for i in range(n, -1, -1):
            if i < n:
                least += min(c for arcs in ARCS[symbols[i]] for _, c, _ in arcs)
            self.price[4 * i:4 * i + 4] = [least] * 4

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(initial, cost, node) in letter order; the end is node -1."""
        i, q = divmod(node, 4)
        if i == len(self.symbols):
            return [("", self.leave[q], -1)]
        d, *rest = [(a, c, 4 * i + 4 + to) for a, c, to in ARCS[self.symbols[i]][q]]
        return [d, ("I", 2, 4 * i + ADDED[q]), *rest]

    def distance(self, start: int) -> int:
        """Least cost from state ``start`` to the end, which must be reachable."""
        price, path = self.price, [start]
        while True:
            node, best, to = path[-1], INF * 2, -1
            for _, c, j in self.arcs(node):
                v = c if j < 0 else c + price[j]
                if v < best:
                    best, to = v, j
            if price[node] < best:      # no tight arc: raise the price and contract
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif to < 0:
                return price[start]
            else:                       # extend over the tight arc
                path.append(to)

    def trace(self, start: int) -> tuple[str, int]:
        """Least initials among the cheapest paths from ``start``, and the state they end in."""
        self.distance(start)
        price, dead, path, letters = self.price, set(), [start], []
        while True:
            node = path[-1]
            for a, c, j in self.arcs(node):
                if price[node] == (c if j < 0 else c + price[j]) and j not in dead:
                    break
            else:                       # tight arcs of this node lead nowhere
                dead.add(path.pop())
                letters.pop()
                continue
            if j < 0:
                return "".join(letters), node % 4
            path.append(j)
            letters.append(a)


def costs(symbols: bytes) -> list[int]:
    """Least cost from each entry state to each exit state, 16 numbers; INF where there is no way.
    Nothing but deletions, and one kept system turn, leads to the first two states."""
    n, out = len(symbols), [INF] * 16
    out[0] = out[5] = 3 * n
    out[1] = min((3 * n - 3 + (s >> 3) for s in symbols if s & 7 == 0), default=INF)
    for exit_ in (2, 3):
        a = Auction(symbols, tuple(0 if q == exit_ else INF for q in range(4)))
        for entry in range(4):
            out[4 * entry + exit_] = a.distance(entry)
    return out


# ---------------------------------------------------------------- damage and symbols
def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, tie, copy) after the planted damage."""
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", blank).alias("role"),
                                F.coalesce("text", blank).alias("text"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    k = F.crc32(F.concat(text("conv"), F.lit(":"), text("turn"))) % 20
    rows = rows.withColumn("k", k).where("k <> 0").select(
        "conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.withColumn("tie", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))))


def _ordered(rows: DataFrame, *more: str) -> list[Column]:
    return [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("tie"), *map(F.col, more)]


def segments(rows: DataFrame) -> DataFrame:
    """(conv, seg, symbols, blank, duplicate, truncated, turn, tie) from damaged rows: a segment is what
    512 neighbours of the sorted table hold of one conversation."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    kind = (F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1)
            .when(F.substring("role", 1, 1) == "a", 2).otherwise(3))
    narrow = rows.select("conv", "turn", "tie", kind.cast("tinyint").alias("kind"), (end == "").alias("blank"),
                         (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("at"))
    narrow = cut_lineage(narrow.orderBy(*_ordered(narrow, "at")).withColumn("mono", F.monotonically_increasing_id()).drop("at"), "turns")
    again = cut_lineage(narrow.where("not blank").groupBy("conv", "tie").agg(F.min("mono").alias("first"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1"), "again")
    rows = join_sized(narrow, again, ["conv", "tie"], "n")
    dup = ~F.col("blank") & F.coalesce(F.col("mono") > F.col("first"), F.lit(False))
    cut = ~F.col("blank") & ~dup & F.col("open")
    symbol = F.col("kind") + F.when(F.col("blank") | dup, 4).otherwise(0) + F.when(cut, 8).otherwise(0)
    flagged = rows.select("conv", F.shiftright("mono", SEGMENT_BITS).alias("seg"), "blank", dup.alias("dup"), cut.alias("cut"),
                          F.struct("mono", symbol.cast("int").alias("s"), "turn", "tie").alias("row"))
    count = lambda c: F.sum(F.col(c).cast("long"))
    got = flagged.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(F.struct("row.mono", "row.s"))).alias("row"),  # 512 at most
                                             F.min_by("row", F.col("row.mono")).alias("top"),
                                             count("blank").alias("blank"), count("dup").alias("duplicate"), count("cut").alias("truncated"))
    return got.select("conv", "seg", F.transform("row.s", lambda x: x.cast("tinyint")).alias("symbols"),
                      "blank", "duplicate", "truncated", F.col("top.turn").alias("turn"), F.col("top.tie").alias("tie"))


# ---------------------------------------------------------------- segments of long conversations
def _per_row(df: DataFrame, keep: list[str], read: list[str], fn, out: str) -> DataFrame:
    """``fn(*values of read) -> tuple`` per row, beside the columns ``keep``."""
    df = df.select(*keep, *read)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + (", " if keep else "") + out
    names = [x.strip().split(" ")[0] for x in out.split(",")]

    def run(batches):
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in read]
            got = [fn(*vals) for vals in zip(*cols)]
            made = pa.table({n: [g[i] for g in got] for i, n in enumerate(names)}, schema=pa.schema(
                [pa.field(n, KINDS[x.strip().split(" ")[1]]) for n, x in zip(names, out.split(","))]))
            arrays = [b.column(b.schema.get_field_index(c)) for c in keep] + [made.column(n).combine_chunks() for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + names)
    return arrow_map(df, run, schema)


KINDS = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64())), "string": pa.string(),
         "int": pa.int32()}


def _through(a: list[int], b: list[int]) -> list[int]:
    """Least costs through two neighbours."""
    x, y = np.array(a).reshape(4, 4), np.array(b).reshape(4, 4)
    return np.minimum((x[:, :, None] + y[None, :, :]).min(1), INF).ravel().tolist()


def _blocks(chain: DataFrame) -> DataFrame:
    """(conv, idx of the block, members in order) of at most FAN members each."""
    block = F.floor(F.col("idx") / FAN).cast("long")
    return chain.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "m"))).alias("row")) \
        .select("conv", "block", "row.idx", "row.m")


def _spread(chain: DataFrame, fold, start: tuple, step) -> DataFrame:
    """(conv, idx, v): the value of every member of a chain, carried along its conversation.  ``fold``
    joins the members of a block to one, ``step(members, v)`` gives the members' values when the
    block's is ``v``; ``start`` is the value of a whole conversation."""
    top = chain.agg(F.max("idx")).first()[0]
    if not top:
        return chain.select("conv", "idx", F.array(*[F.lit(x).cast("long") for x in start]).alias("v"))
    blocks = cut_lineage(_blocks(chain), "blocks")
    above = _spread(cut_lineage(_per_row(blocks, ["conv", "block"], ["m"], lambda m: (fold(m),), "m array<long>")
                                .withColumnRenamed("block", "idx"), "folded"), fold, start, step)
    above = above.select(F.col("conv").alias("_conv"), F.col("idx").alias("_block"), "v")
    on = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    vals = _per_row(blocks.join(above, on), ["conv", "idx"], ["m", "v"], lambda m, v: (step(m, v),), "vs array<array<long>>")
    return cut_lineage(vals.select("conv", F.explode(F.arrays_zip("idx", "vs")).alias("e")).select("conv", "e.idx", F.col("e.vs").alias("v")), "spread")


def _fold_costs(members):
    out = members[0]
    for m in members[1:]:
        out = _through(out, m)
    return out


def _leave_costs(members, v):
    """Exit costs of every member, from the block's own exit costs."""
    out = []
    for m in reversed(members):
        out.append(list(v))
        v = (np.array(m).reshape(4, 4) + np.array(v)).min(1).tolist()
    return out[::-1]


def _fold_states(members):
    out = [0, 1, 2, 3]
    for m in members:
        out = [m[q] for q in out]
    return out


def _entries(members, v):
    out = []
    for m in members:
        out.append([v[0]])
        v = [m[v[0]]]
    return out


def solved(segs: DataFrame) -> DataFrame:
    """(conv, seg, letters, cost): the initials of every segment and what they cost."""
    many = segs.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    segs = cut_lineage(join_sized(segs, cut_lineage(many.where("n > 1"), "many"), ["conv"], "n"), "segs")

    def whole(symbols, leave, entry, last):
        a = Auction(bytes(symbols), tuple(leave))
        letters, state = a.trace(entry)
        return letters + (CLOSING[state] if last else ""), a.price[entry] - (0 if last else leave[state])

    alone = _per_row(segs.where("n is null"), ["conv", "seg"], ["symbols"],
                     lambda s: whole(s, CLOSE, 0, True), "letters string, cost long")
    long = segs.where("n > 1")
    chain = places(long.select("conv", "seg", "symbols"), ["conv"], [F.col("seg")], "idx")
    chain = cut_lineage(_per_row(chain, ["conv", "seg", "idx", "symbols"], ["symbols"],
                                 lambda s: (costs(bytes(s)),), "m array<long>"), "chain")
    leave = _spread(chain.select("conv", "idx", "m"), _fold_costs, CLOSE, _leave_costs)
    with_leave = cut_lineage(_same(chain.drop("m"), leave.withColumnRenamed("v", "leave")), "leave")

    def exits(symbols, leave):
        a = Auction(bytes(symbols), tuple(leave))
        return [a.trace(q)[1] for q in range(4)],

    states = cut_lineage(_per_row(with_leave, ["conv", "idx"], ["symbols", "leave"], exits, "m array<long>"), "states")
    entry = _spread(states, _fold_states, (0,), _entries)
    ready = _same(with_leave, entry.withColumnRenamed("v", "entry"))
    last = chain.groupBy("conv").agg(F.max("idx").alias("end"), F.count(F.lit(1)).alias("n"))
    ready = join_sized(cut_lineage(ready, "ready"), cut_lineage(last, "last"), ["conv"], "n")
    pieces = _per_row(ready.select("*", (F.col("idx") == F.col("end")).alias("last")), ["conv", "seg"],
                      ["symbols", "leave", "entry", "last"], lambda s, v, e, last: whole(s, v, e[0], last), "letters string, cost long")
    return alone.unionByName(pieces)


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.withColumnsRenamed({"conv": "_conv", "idx": "_idx"})
    return a.join(b, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("idx") == F.col("_idx"))).drop("_conv", "_idx")


# ---------------------------------------------------------------- repaired conversations
OUT = ("conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class _Stream:
    """The conversation that is being read: one row of it is held at a time."""

    def __init__(self, conv):
        self.conv, self.ops, self.state = conv, deque(), 0
        self.low = self.high = self.turn = None
        self.turns = self.illegal = self.cost = 0
        self.counts = [0, 0, 0]
        self.before = None
        self.audit, self.sha, self.rows = [], hashlib.sha256(), 0

    def put(self, role, text):
        self.sha.update((b"\n" if self.rows else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.rows += 1

    def insert(self):
        self.state = ADDED[self.state]
        self.put(ROLE[self.state], "")

    def row(self, turn, role, text):
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        while (op := self.ops.popleft()) == "I":
            self.insert()
        if op == "K":
            self.state = KEPT["sua".index(role[0])][self.state]
            self.put(role, text)
        elif op == "R":
            self.state = ADDED[self.state]
            self.put(ROLE[self.state], text)

    def done(self):
        while self.ops:
            self.ops.popleft()
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _stream(batches):
    names = [x.split(" ")[0] for x in OUT.split(", ")]
    schema = pa.schema([pa.field(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    current, ready, none = None, [], object()
    last = none
    for b in batches:
        for conv, turn, role, text, letters, cost, counts in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
            if conv != last or last is none:
                if current is not None:
                    ready.append(current.done())
                current, last = _Stream(conv), conv
            if letters is not None:
                current.ops.extend(letters)
                current.audit.append(letters)
                current.cost += cost
                current.counts = [a + c for a, c in zip(current.counts, counts)]
            else:
                current.row(turn, role, text)
        if len(ready) > 5000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in ready], schema)
            ready = []
    if current is not None:
        ready.append(current.done())
    if ready:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in ready], schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the table: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    rows = damaged(conversations)
    segs = cut_lineage(segments(rows), "segments")
    letters = cut_lineage(solved(segs), "letters").withColumnsRenamed({"conv": "_conv", "seg": "_seg"})
    on = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("seg") == F.col("_seg"))
    null = lambda t: F.lit(None).cast(t)
    counts = F.array("blank", "duplicate", "truncated")
    plans = segs.join(letters, on).select("conv", "turn", "tie", F.lit(-1).alias("copy"), null("string").alias("role"),
                                          null("string").alias("text"), "letters", "cost", counts.alias("counts"), "seg")
    texts = rows.select("conv", "turn", "tie", "copy", "role", "text", null("string").alias("letters"), null("long").alias("cost"),
                        null("array<long>").alias("counts"), null("long").alias("seg"))
    both = plans.unionByName(texts).repartition("conv").sortWithinPartitions(*_ordered(rows, "copy", "seg"))
    got = arrow_map(both.select("conv", "turn", "role", "text", "letters", "cost", "counts"), _stream, OUT)
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    zero = F.lit(0).cast("long")
    return ids.join(got, F.col("id").eqNullSafe(F.col("conv")), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
