"""Null, repeated and very large ids, rows that share an id, and texts with extreme runs: every row
is judged by itself."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
import llm_cases as C
import test_simhash as S
import test_suffix as X
from clickstack.llm import decontam, langid, packing, quality, simhash, suffix, toxicity, warc
from clickstack.llm.queries import tokenizer_files

LINE = "A passage of some length that is repeated in another document, word by word, with all its commas and full stops in place. "


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("text", [" " * 1_000_100 + "end", "a" + "\n" * 1_000_000, "x" * 300_000, "漢字" * 100_000, "　" * 400_000 + "b", "a b " * 5000])
def test_tokens_of_extreme_runs(spark, text):
    from tokenizers import Tokenizer
    files = tokenizer_files()
    got = packing.token_pieces(frame(spark, [(1, text)]), files["tokenizer_path"], 1 << 30, 1, True, files["ranks_path"]).first()
    assert got.ids == Tokenizer.from_file(files["tokenizer_path"]).encode(text, add_special_tokens=False).ids + [1]


def test_suffix_rows_of_one_id(spark):
    clean = "Nothing in this text occurs anywhere else, so that every one of its bytes has to stay where it is, whatever ids say. " * 1
    rows = [(1, LINE * 2), (5, clean), (5, "b" + LINE), (None, "other words " + LINE), (None, clean.upper()), (None, LINE + "end"), (7, None)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    want = X.brute([(k, rows[i][1]) for k, i in enumerate(order)])
    got = suffix.kept_texts(frame(spark, rows).coalesce(1)).collect()
    kept = lambda b, gone: bytes(c for c, g in zip(b, gone) if not g)
    assert sorted((str(rows[i][0]), kept(*want[k])) for k, i in enumerate(order)) == sorted((str(r.doc_id), bytes(r.kept)) for r in got)


def test_replacement_characters_stay(spark):
    rows = [(1, "� broken é " + LINE), (2, "a � b é" + LINE + "�漢" + LINE + "c")]
    got = {r.doc_id: r.text for r in suffix.without_repeats(frame(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2].startswith("a � b") and "�漢" in got[2] and got[2].endswith("c")


def test_pipeline_stages_by_row(spark):
    t, other = "one two three four five six seven eight nine ten", "quite another text with nothing in common at all"
    rows = [(0, t), (1, t), (1, other), (None, t), (None, t), (None, other + " but longer than it was")]
    docs = frame(spark, [(d, x, "en", "s", len(x)) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, C.SMALL).collect()]
    assert sorted(x for _, x in kept) == sorted([t, other, rows[5][1]]) and (0, t) in kept
    item = C.texts(spark, "benchmark", "item_id")[3][1]
    leaks = docs.limit(0).unionByName(frame(spark, [(9, item, "en", "s", 1), (9, t, "en", "s", 1), (None, item, "en", "s", 1), (None, other, "en", "s", 1)], docs.schema))
    assert sorted(r.text for r in P.drop_leaks(spark, leaks, C.SMALL).collect()) == sorted([t, other])


def test_quality_scores_every_row(spark):
    docs = C.table(spark, "documents").select("doc_id", "lang", "text").where("doc_id < 40")
    more = frame(spark, [(None, "en", "x y"), (1, "en", None), (1, None, "en"), (None, "en", "x y"), (2, "de", "漢字 und 字漢"), (2, "de", "漢字 und 字漢")],
                 "doc_id long, lang string, text string")
    docs = docs.unionByName(more).unionByName(docs.where("doc_id = 3"))
    labels = C.table(spark, "labels").selectExpr("doc_id", "1 as quality").where("doc_id < 39")

    def judged(rows):
        got = quality.judged(docs, labels, table_rows=rows).collect()
        return sorted((str(r.doc_id), r.keep, round(r.perplexity or 0, 6), round(r.threshold or 0, 6)) for r in got)
    a, b, c = judged(10**6), judged(0), judged(3000)
    assert len(a) == docs.count() and a == b == c


def test_quality_threshold_and_keep(spark):
    docs, labels = C.table(spark, "documents"), C.table(spark, "labels")
    rows = quality.judged(docs, labels, quantile=0.9).join(docs.select("doc_id", "lang"), "doc_id").collect()
    import zlib
    fresh = {r.doc_id for r in labels.where("quality = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 10 == 0}
    known = collections.defaultdict(list)
    for r in rows:
        if r.doc_id in fresh and r.perplexity is not None:
            known[r.lang].append(r.perplexity)
            known[""].append(r.perplexity)
    for r in rows:
        v = sorted(known[r.lang] or known[""])
        assert math.isclose(r.threshold, v[max(0, math.ceil(0.9 * len(v)) - 1)], rel_tol=1e-9)
        assert r.keep == (r.perplexity is not None and r.perplexity <= r.threshold)


def test_far_characters_are_told_apart():
    codes = {}
    for a in (0x4E00, 0x4E01, 0x9FFF, 0xAC00, 0x1F600, 0x10FFFF, 2976, 2975, 97):
        data = chr(a).encode()
        codes[a] = tuple(quality.gram_codes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 5)[1].tolist())
    assert len(set(codes.values())) == len(codes) and len(codes[97]) == 1 and len(codes[0x4E00]) == 2


def test_every_page_is_archived(spark, tmp_path):
    rows = [(1, "u1", "a"), (None, "u2", "b"), (2, "u3", "same"), (2, "u4", "other"), (3, None, "same"), (3, "u6", "same"), (None, "u7", "b"),
            (None, "u8", "c" * 40_000), (None, "u9", "c" * 40_000)]
    warc.write(frame(spark, rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    got = warc.payloads(warc.reassembled(warc.read(spark, str(tmp_path / "a")))).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    at = {r.record_id: r for r in got if r.type == "response"}
    assert sorted((r.page or "", bytes(r.payload if r.type == "response" else at[r.refers].payload).decode()) for r in got) == sorted(
        (str(p or ""), h) for p, _, h in rows)
    assert collections.Counter(r.digest for r in got if r.type == "response").most_common(1)[0][1] == 1
    assert {r.page for r in got if r.type == "response" and bytes(r.payload) == b"same"} == {"3"}


def test_leaks_by_row_and_item_text(spark):
    words = "the quick red fox jumps over the lazy dog near the old river bank every single summer morning".split()
    second = "which planet of the solar system has the largest number of known moons today"
    bench = frame(spark, [(1, " ".join(words)), (1, second), (None, "an item without any number of its own is still an item"), (2, None)], "item_id long, text string")
    parts = [(None, " ".join(words[i:i + 7])) for i in range(12)]
    docs = frame(spark, parts + [(4, "so " + second + " then"), (4, "clean text"), (None, "an item without any number of its own is still an item")])
    got = [(r.doc_id, r.item_id, r.kind, r.share) for r in decontam.contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == [(4, 1, "verbatim", 1.0), (None, None, "verbatim", 1.0)]


def test_toxicity_bound_holds_for_rows(spark, monkeypatch):
    docs = C.table(spark, "documents").select("doc_id", "text")
    labels = C.table(spark, "labels")
    hot = labels.where("toxic is not null").first().doc_id
    many = spark.range(500).select(F.lit(hot).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    seen = []
    learn = toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda s, *a, **k: (seen.append(s.count()), learn(s, *a, **k))[1])
    toxicity.fit(docs.unionByName(many).unionByName(many), labels, fit_rows=50)
    assert max(seen) <= 50


def test_one_letter_has_a_language(spark):
    train = frame(spark, [("aa", "bad dab bad cab " * 20), ("zz", "I go. I am. I see it. I do " * 20)], "lang string, text string")
    models = langid.prototypes(train)
    got = {r.doc_id: r for r in langid.predict(frame(spark, [(1, "I"), (2, "it"), (3, "1 2"), (4, None), (5, "")]), models).collect()}
    assert got[1].lang_pred == "zz" and got[1].score > 0 and got[2].lang_pred == "zz"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))


def test_simhash_of_very_large_ids(spark):
    big = 1 << 62
    rows = [(big + 5, "a b c d"), (big + 9, "a b c d"), ((1 << 63) - 1, "q r s t u"), (None, "w w w w"), (None, "w w w w"), (-(1 << 63), ""), (None, "a b c d")]
    S.compare(simhash.simhash_groups(frame(spark, rows)).collect(), rows)


def test_hashes_of_the_kept_bytes(spark):
    got = suffix.kept_texts(frame(spark, [(1, "abc"), (1, "abc")])).collect()
    assert {hashlib.sha256(bytes(r.kept)).hexdigest() for r in got} == {hashlib.sha256(b"abc").hexdigest()}
