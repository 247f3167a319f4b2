import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import llm_cases as C
from clickstack.llm import suffix
from clickstack.llm.queries import QUERIES


def brute(docs, width=100):
    """{doc: (bytes, removed flags)}; the doc_ids are the rows' own."""
    seen, out = set(), {}
    for d, t in sorted(dict(docs).items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            s = b[i:i + width]
            if s in seen:
                gone[i:i + width] = b"\1" * width
            seen.add(s)
        out[d] = b, gone
    return out


def test_query_matches_brute_force(spark):
    want = brute(C.texts(spark))
    for r in QUERIES["op10_suffix_dedup"](spark, C.SMALL).collect():
        b, gone = want[r.doc_id]
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("width,key", [(20, 8), (12, 11), (9, 3)])
def test_random_repeats(spark, width, key):
    rng = random.Random(width)
    bits = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 40))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(bits) if rng.random() < .8 else rng.choice("cdé") for _ in range(rng.randint(0, 12))))
            for i in range(60)]
    want = brute(docs, width)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in suffix.kept_texts(df, width, key).collect():
        b, gone = want[r.doc_id]
        flags = bytearray(len(b))
        for s in r.spans:
            flags[s.lo:s.hi] = b"\1" * (s.hi - s.lo)
        assert flags == gone, r.doc_id


def test_awkward_rows(spark):
    df = C.docs(spark)
    rows = df.collect()
    want = brute([(r.doc_id, r.text) for r in rows])
    got = suffix.kept_texts(df).collect()
    assert len(got) == len(rows)
    for r in got:
        b, gone = want[r.doc_id]
        assert bytes(r.kept) == bytes(c for c, g in zip(b, gone) if not g), r.doc_id
    cut = suffix.without_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert all((r.text is None) == (r.doc_id == 4) and (r.text is None or r.n_chars == len(r.text)) for r in cut.collect())
    assert suffix.kept_texts(C.empty_docs(spark)).collect() == []


def test_a_long_text_is_taken_in_runs(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix.sampled(data, np.array([0, 5000]), 100, 48)
    monkeypatch.setattr(suffix, "RUN", 700)
    parts = suffix.sampled(data, np.array([0, 5000]), 100, 48)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_cut_characters_go():
    data = "aé漢🙂b�c".encode()
    for a in range(len(data) + 1):
        for b in range(a, len(data) + 1):
            lo, hi = [a], [b]
            suffix._outward(data, lo, hi)
            assert lo[0] <= a and hi[0] >= b and hi[0] - b < 4 and a - lo[0] < 4
            assert "aé漢🙂b�c".startswith(data[:lo[0]].decode()) and "aé漢🙂b�c".endswith(data[hi[0]:].decode())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=50).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40))
def test_deep_shallow_order(strings):
    order, lcp = suffix.deep_shallow(strings, list(range(len(strings))))
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    for i in range(1, len(order)):
        a, b = strings[order[i - 1]], strings[order[i]]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert lcp[i] == n
