import bisect
import collections
import hashlib
import math
import re

import pytest

import llm_cases as C
from clickstack.llm import decontam, quality, spotsigs
from clickstack.llm.queries import QUERIES

WORDS = re.compile(r"[^\W\d_]+|\d+")


def test_contamination_matches_brute_force(spark):
    docs, items = C.texts(spark), C.texts(spark, "benchmark", "item_id")
    want = set()
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, t in items for w in [WORDS.findall(t.lower())]}
    n = {i: len(WORDS.findall(t)) - 4 for i, t in items}
    for d, t in docs:
        w = WORDS.findall(t.lower())
        mine = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
        want |= {(d, i) for i in sets if sets[i] and len(sets[i] & mine) >= 0.8 * n[i]}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, C.SMALL).collect()}
    assert got == want and want


ITEMS = [(1, "Alice asked whether Bob had bought 12 kg of apples for the winter market in the old harbour town of Kiel."),
         (2, "short item only"), (3, None), (4, ""), (4, ""), (5, "7 8 9 10 11 12 13")]
CASES = [
    (10, "Intro text. Alice asked whether Bob had bought 12 kg of apples for the winter market in the old harbour town of Kiel. End."),
    (11, "We know that Clara asked whether David had bought 350 kg of apples for the winter market in the old harbour town of Rostock."),
    (12, "Alice asked whether her sister had sold all the pears in the summer market of the new town by the sea."),
    (13, None), (14, ""), (15, "a SHORT item, only!"), (16, "1 2 3 4 5 6 7"), (16, "1 2 3 4 5 6 7"),
    (None, "nothing here"), (17, "word " * 20_000),
]


@pytest.mark.parametrize("few", [1000, 0])
def test_contamination_cases(spark, few):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as hash")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, items, filter_windows=few).collect()}
    assert set(got) == {(10, 1), (11, 1), (15, 2)}
    assert got[10, 1].kind == "verbatim" and got[11, 1].kind == "re-parameterised" and got[11, 1].slots_changed >= 3
    assert decontam.contaminated(docs.where("false"), items).collect() == []
    assert decontam.contaminated(docs, items.where("false")).collect() == []


def test_slots_must_be_consistent(spark):
    item = ("Then early one morning Anna met her old friend Berta near the river, and later that same day Anna gave her old "
            "friend Berta some bread, so in the evening Berta told her old friend Anna that all was well.")
    names = {"Anna": iter(["Carl", "Dora", "Emil"]), "Berta": iter(["Hans", "Ida", "Jon"])}
    mixed = re.sub("Anna|Berta", lambda m: next(names[m[0]]), item)
    same = item.replace("Anna", "Xaver").replace("Berta", "Yvonne")
    docs = spark.createDataFrame([(1, "We saw it. " + same), (2, "We saw it. " + mixed)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(docs, items).collect()] == [1]


def test_variants_side_by_side(spark):
    """Two re-parameterised variants in one document, equally often: slot by slot a tie."""
    item = ("Then early one morning Anna met old Berta near the river and gave young Clara some bread, so later Anna took "
            "poor Dora home with Berta and left Clara beside Dora for the night.")
    name = re.compile("Anna|Berta|Clara|Dora")
    variants = [name.sub(lambda m, k=k: m[0] + "qxzvw"[k] + "bcdfg"[(3 * k) % 5], item) for k in range(5)]
    gap = variants[2].replace("some bread,", "some bread that the whole village had baked for the feast,")
    split = [name.sub(lambda m, k=iter(range(99)): f"{m[0]}{'abcdefghijkl'[next(k)]}x", item)]
    texts = [" ".join(variants[:n]) for n in (1, 2, 3, 4, 5)] + [" ".join([gap, variants[3]]), split[0]]
    docs = spark.createDataFrame([(k, "We saw it. " + t) for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, items).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5}
    assert all(got[k].share == 1.0 and got[k].slots_changed == 4 for k in range(5))


DENSE = [
    (1, "Add 3 and 5 then 7 and 9 to 2", "Add 31 and 52 then 73 and 94 to 25"),
    (2, "Tom has 3 apples. Tom gives 2 away. Tom counts again what he still has.",
     "Ann has 8 apples. Ann gives 6 away. Ann counts again what he still has."),
    (3, "Der Vater kauft 3 kg Birnen, 4 kg Kirschen, 5 kg Pflaumen, 6 kg Quitten.",
     "Der Vater kauft 13 kg Birnen, 24 kg Kirschen, 35 kg Pflaumen, 46 kg Quitten."),
    (4, "Mix 3 kg Salt 4 kg Sand with 5 kg Lime 6 kg Clay under 7 kg Loam", "Mix 13 kg Rye 14 kg Oat with 15 kg Corn 16 kg Rice under 17 kg Bran"),
]


def test_items_dense_in_slots(spark):
    docs = spark.createDataFrame([(k, "we saw it; " + new) for k, _, new in DENSE] + [(9, "add 1 or 2 then leave 3 and 4 to rest")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(k, old) for k, old, _ in DENSE], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, items).collect()}
    assert set(got) == {(k, k) for k, _, _ in DENSE} and all(r.kind == "re-parameterised" for r in got.values())


def brute_kn(counts, order):
    """logp of an n-gram (tuple) under interpolated modified Kneser-Ney."""
    levels = [counts]
    for _ in range(order - 1):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    levels.reverse()
    cuts = []
    for lv in levels:
        n = [sum(v == i for v in lv.values()) for i in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            cuts.append((0.5, 0.75, 0.9))
            continue
        y = n[0] / (n[0] + 2 * n[1])
        d = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 0.9)
        cuts.append(tuple(min(max(x, .05), i + .95) for i, x in enumerate(d)))
    space = [collections.defaultdict(lambda: [0, 0.0]) for _ in levels]
    for k, lv in enumerate(levels):
        for g, c in lv.items():
            space[k][g[:-1]][0] += c
            space[k][g[:-1]][1] += cuts[k][min(c, 3) - 1]

    def p(g):
        k = len(g) - 1
        low = p(g[1:]) if k else 1 / (len(levels[0]) + 1)
        if g[:-1] not in space[k]:
            return low
        total, cut = space[k][g[:-1]]
        c = levels[k].get(g, 0)
        return (c - cuts[k][min(c, 3) - 1] if c else 0) / total + cut / total * low
    return p


@pytest.mark.parametrize("table_rows", [10**6, 0])
def test_perplexity_matches_brute_force(spark, table_rows):
    docs = C.table(spark, "documents").where("doc_id < 60")
    labels = C.table(spark, "labels").selectExpr("doc_id", "1 as quality").where("doc_id < 30")
    got = {r.doc_id: r.perplexity for r in quality.judged(docs, labels, order=3, table_rows=table_rows).collect()}
    import zlib
    texts = dict(C.texts(spark))
    trusted = [d for d in {r.doc_id for r in labels.collect()} if zlib.crc32(str(d).encode()) % 10]
    grams = lambda t: [tuple(("\0\0" + re.sub("[\t-\r]", " ", t))[i:i + 3]) for i in range(len(t))]
    p = brute_kn(collections.Counter(g for d in trusted for g in grams(texts[d])), 3)
    for d in list(got)[:12]:
        g = grams(texts[d])
        assert math.isclose(got[d], math.exp(-sum(math.log(p(x)) for x in g) / len(g)), rel_tol=1e-4)


def test_quality_keeps_trusted_and_drops_noise(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op2_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.6


def test_quality_awkward_rows(spark):
    df = C.docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 1), (99, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.judged(df, labels).collect()
    assert len(rows) == df.count() and all(not r.keep and r.perplexity is None for r in rows if r.doc_id in (4, 5))
    assert all(r.keep == (r.doc_id not in (4, 5)) for r in quality.judged(df, labels.where("false")).collect())
    assert quality.judged(C.empty_docs(spark), labels).collect() == []


ANCHOR = set(spotsigs.ANCHORS)
ALNUM = re.compile(r"[^\W_]+")


def brute_spots(text, chain=2):
    w = ALNUM.findall((text or "").lower())
    p = [i for i, x in enumerate(w) if x not in ANCHOR]
    out = set()
    for i, x in enumerate(w):
        if x in ANCHOR:
            q = bisect.bisect(p, i)
            c = [w[j] for j in p[q:q + chain]]
            if c:
                out.add((x, *c, *[""] * (chain - len(c))))
    return out or {(None, *w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_spots_match_brute_force(spark):
    docs = sorted(C.texts(spark), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op6_spotsigs"](spark, C.SMALL).collect()}
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(docs):
        other = docs[(i + 1) % len(docs)][1]
        k = len(t) // 3
        edited, r = t[:len(t) - k] + other[:k], got[d]
        a, b, c = brute_spots(t), brute_spots(edited), brute_spots(other)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint.split()) == len(a) and len(r.edited_fingerprint.split()) == len(b)
        assert math.isclose(r.near_edited, jaccard(a, b)) and math.isclose(r.near_next, jaccard(a, c))


@pytest.mark.parametrize("per_bucket", [2, 1000])
def test_spots_awkward_rows(spark, per_bucket):
    df = C.docs(spark)
    rows = spotsigs.beside_next(df, per_bucket=per_bucket).collect()
    assert len(rows) == df.count()
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()}, reverse=True)
    after = {a[:2]: b[2] for a, b in zip(order, order[1:] + order[:1])}
    text = {a[:2]: a[2] for a in order}
    for r in rows:
        key = r.doc_id is not None, r.doc_id or 0
        t, k = text[key], len(text[key]) // 3
        assert r.n_chars == len(t) and r.edited == t[:len(t) - k] + after[key][:k]
    assert spotsigs.beside_next(C.empty_docs(spark)).collect() == []
    assert len(spotsigs.beside_next(df.where("doc_id = 1")).collect()) == 1


def test_near_classes_match_brute_force(spark):
    docs = C.texts(spark)
    sets = {d: brute_spots(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r.class_id for r in spotsigs.near_classes(C.table(spark, "documents")).collect()}
    assert got == {d: find(d) for d in ids}
    assert spotsigs.near_classes(C.empty_docs(spark)).collect() == []


def test_native_plan_has_no_python(spark):
    plan = QUERIES["op6_spotsigs"](spark, C.SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
