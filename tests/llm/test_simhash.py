import re

import numpy as np
import xxhash

import llm_cases as C
from clickstack.llm import simhash
from clickstack.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fp(text, width=3):
    w = WORD.findall((text or "").translate(LOWER))
    sh = [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, bits=3):
    """fps: list of (id, fp); smallest id reachable."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def compare(rows, docs):
    fps = [(d, brute_fp(t)) for d, t in docs]
    want = sorted(((d is None, d or 0), f"{f:016x}", c) for (d, f), c in zip(fps, brute_groups(fps)))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in rows) == want


def test_query_matches_brute_force(spark):
    compare(QUERIES["op5_simhash"](spark, C.SMALL).collect(), C.texts(spark))


def test_awkward_rows(spark):
    df = C.docs(spark)
    compare(simhash.simhash_groups(df).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert simhash.simhash_groups(C.empty_docs(spark)).collect() == []


def test_hash_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4800, 400)
    size = np.concatenate([np.arange(200), rng.integers(0, 200, 200)])
    got = simhash.xxh64(data, start, size)
    assert [int(g) for g in got] == [xxhash.xxh64_intdigest(data[a:a + n].tobytes(), 42) for a, n in zip(start, size)]


def random_fps(seed, n=1500):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 10)
    out = set()
    for b in base:
        for _ in range(10):
            flip = 0
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                flip |= 1 << int(bit)
            out.add((int(b) ^ flip) & (1 << 64) - 1)
    return sorted(out)


def test_index_equals_pairs():
    fps = random_fps(3)
    index = simhash.GrayIndex(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
    label = index.linked(3, chunk=64)
    want = brute_groups([(i, int(f)) for i, f in enumerate(index.fp)])
    assert label.tolist() == want


def test_crowded_blocks_are_dealt_again(spark):
    fps = random_fps(4, 600)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    links = simhash.near_links(df, 3, hot=3).collect()
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in links:
        parent[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
    assert [find(i) for i in range(len(fps))] == brute_groups([(i, f) for i, f in enumerate(fps)])
