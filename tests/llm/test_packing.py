import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import llm_cases as C
from clickstack.llm import packing
from clickstack.llm.queries import QUERIES, tokenizer_files


def check(rows, docs, seq_len=2048):
    import public_tokenizers
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d is None, d or 0, len(i) + 1) for d, t in docs for i in [encode(t or "")])
    ids = {d: np.array(encode(t or "") + [1], "<u4") for d, t in docs}
    got = sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0)
    assert got == want
    total = {}
    for r in rows:
        cut = ids[r.doc_id][r.start:r.start + r.length]
        assert len(cut) == r.length > 0 and r.ids_crc32 == zlib.crc32(cut.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    copies = {d: sum(x == d for x, _ in docs) for d in ids}
    assert total == {d: copies[d] * len(i) for d, i in ids.items()}
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(seqs)


def test_query_is_an_exact_cover(spark):
    rows = QUERIES["op1_packing"](spark, C.SMALL).collect()
    docs = C.texts(spark)
    n = check(rows, docs)
    assert sum(r.length for r in rows) / (n * 2048) > 0.98


def test_awkward_rows(spark):
    df = C.docs(spark)
    rows = packing.pack(df, tokenizer_files()["tokenizer_path"]).collect()
    check(rows, [(r.doc_id, r.text) for r in df.collect()])
    assert packing.pack(C.empty_docs(spark), tokenizer_files()["tokenizer_path"]).collect() == []


def test_ids_are_kept_on_request(spark):
    rows = packing.pack(C.docs(spark).where("doc_id < 8"), tokenizer_files()["tokenizer_path"], seq_len=16, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 16 for r in rows)


def test_special_token_text_is_encoded_alike():
    import public_tokenizers as P
    a, b = packing.encoder(P.path("byte_bpe_50k.json")), packing.encoder(tokenizer_files()["tokenizer_path"])
    for t in ("", "a<|endoftext|>b", "  \n\n x", "漢字🙂 é\u00a0x", "it's I'LL 12ab", "x" * 3000):
        assert a(t) == list(b(t)), t


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=64))
def test_patterns_cover_the_demand(hist):
    sizes, demand = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    plan = packing.cutting_patterns(sizes, demand, 64)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert all((p * sizes).sum() <= 64 and t > 0 for p, t in plan)
    # a single size can waste a third of each sequence, as three of 22 do not fit
    alone = (-(-demand // (64 // sizes))).sum()
    assert sum(t for _, t in plan) <= max(1.25 * (sizes * demand).sum() / 64 + (demand[sizes > 32]).sum() + 2, alone)


def test_known_optimum():
    # 3 of 5 and 2 of 3 in a room of 10: 5+5, 5+3 and 3 would waste; best is 2 rolls of 5+5 / 5+3 and one 3
    plan = packing.cutting_patterns(np.array([3, 5, 7]), np.array([300, 200, 300]), 10)
    assert sum(t for _, t in plan) == 400  # 7+3 and 5+5 leave nothing over


def test_greedy_filling_gets_the_leftover_only(monkeypatch):
    asked, fill = [], packing.fill
    monkeypatch.setattr(packing, "fill", lambda sizes, demand, room: asked.append(demand.sum()) or fill(sizes, demand, room))
    rng = np.random.default_rng(1)
    sizes, demand = np.arange(1, 65), rng.integers(20, 60, 64)
    plan = packing.cutting_patterns(sizes, demand, 64)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert len(asked) == 1 and asked[0] < demand.sum() / 4


@pytest.mark.parametrize("unit", [3, 5])
def test_unit_must_divide(spark, unit):
    with pytest.raises(ValueError):
        packing.pack(C.docs(spark), tokenizer_files()["tokenizer_path"], unit=unit)
