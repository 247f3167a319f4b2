import hashlib
import random
import zlib

import duckdb
import numpy as np

import llm_cases as C
from clickstack.llm import prefixtrie
from clickstack.llm.queries import ORACLE, QUERIES
from compare import rows_of


def brute(rows):
    """Node rows of (conv_id, turn, role, text) rows, by walking every path."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    for v in convs.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
    ids, up, depth, size, members, ends = {}, [None], [0], [0], [[]], [[]]  # node 0 is the root
    for c, own in convs.items():
        turns = own
        if c is not None:
            h = zlib.crc32(str(c).encode()) % 9
            turns = convs.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + own[h:]
        at = 0
        members[0].append(c)
        for _, role, text in turns:
            key = (at, role, text)
            if key not in ids:
                ids[key] = len(up)
                up.append(at)
                depth.append(depth[at] + 1)
                size.append(len(text.encode()))
                members.append([])
                ends.append([])
            at = ids[key]
            members[at].append(c)
        ends[at].append(c)
    low = lambda cs: min((c for c in cs if c is not None), default=None)
    n = len(up) if convs else 0
    kids, leaves, saved = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # children come after their parents
        leaves[i] += not kids[i]
        saved[i] += (len(members[i]) - 1) * size[i]
        if i:
            kids[up[i]] += 1
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    order = lambda cs: sorted(cs, key=lambda c: (c is None, c or 0))
    return sorted(str((low(members[i]), depth[i], low(members[up[i]]) if i else None, len(members[i]), kids[i], leaves[i], saved[i], hashlib.sha256(
        ",".join("" if c is None else str(c) for c in order(ends[i])).encode()).hexdigest())) for i in range(n))


def check(df, got):
    want = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_query_matches_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{C.SMALL}/conversations.parquet'")
    df, rel = QUERIES["op13_prefix_trie"](spark, C.SMALL), con.sql(ORACLE["op13_prefix_trie"])
    check(C.table(spark, "conversations"), df)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "", None]), rng.choice(["a", "b", "", None, "漢字", " "]))
            for c in [*range(-12, 40), 400, 1003, (1 << 62) + 1] for t in rng.sample([None, *range(12)], rng.randint(1, 11))
            for _ in range(rng.choice([1, 1, 2]))]
    rows += [(None, 1, "user", "a"), (None, None, None, None)]
    rows += [(c, t, "user", "a" if t < 1500 else f"{c} {t}") for c in (50, 51, 52) for t in range(2600)]  # several pieces
    rows += [(c, 0, "user", "same") for c in range(2000, 4000)] + [(60, 1, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", *[f"'{c}' as {c}" for c in ("conv", "pos", "n", "h", "k", "base", "low", "depth", "a", "b", "x", "band", "kind", "at", "length")])
    check(df, prefixtrie.trie(df))
    assert prefixtrie.trie(df.where("false")).collect() == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, n).astype(np.uint64)
        a[:n // 2] = a[0] if n else 0  # digests that agree in one half
        table = prefixtrie.SlotTable(a, b)
        assert sorted(table.slots(a, b)) == list(range(n))
        assert (table.slots(b + np.uint64(1), a) == -1).all()


def test_colliding_digests_are_seen(monkeypatch):
    arrays = {"conv": np.array([0, 1]), "null": np.zeros(2, bool), "band": np.zeros(2, np.int64), "kind": np.ones(2, np.int64),
              "depth": np.ones(2, np.int64), "turn": np.array([[1, 2], [3, 4]], np.uint64), "n_bytes": np.zeros(2, np.int64),
              "end": np.ones(2, bool), "x": np.zeros(2, np.int64), "y": np.zeros(2, np.int64)}
    assert prefixtrie.Shard(arrays, 1).sound
    monkeypatch.setattr(prefixtrie, "turn_digests", lambda t, d, s: (np.ones(len(d), np.uint64), np.ones(len(d), np.uint64)))
    assert not prefixtrie.Shard(arrays, 1).sound
