import llm_cases as C
from clickstack.llm import langid, toxicity
from clickstack.llm.queries import QUERIES
from pyspark.sql import functions as F


def test_grammar_weighs_how_words_stand():
    s = toxicity.Scorer({"idiot": (toxicity.INSULT, 2.0)})
    plain, aimed = s.clause("the idiot walks"), s.clause("you are an idiot")
    denied, told = s.clause("he is not an idiot"), s.clause("someone said idiot")
    assert aimed > plain == 2.0 and denied < plain and told < plain
    assert s.features("a fine day, nothing else")[0] == 0 and s.features("")[0] == 0


def test_long_clauses_are_whole():
    import math
    s = toxicity.Scorer({"idiot": (toxicity.INSULT, 2.0)})
    filler = "word " * 200
    for text in (f"you {filler}idiot", f"someone said {filler}idiot", f"idiot {filler}idiot {filler}idiot", "idiot " + "x" * 392 + " idiot"):
        total, top, n = s.features(text)[:3]
        assert math.isclose(math.expm1(total), s.clause(text)) and math.isclose(math.expm1(n), 1), text[:20]
    assert math.isclose(math.expm1(s.features("you walk。idiot")[0]), 2.0)


def test_composition_runs_both():
    a, b = toxicity.negated(), toxicity.reported()
    both = a.compose(b)
    words = [toxicity.NEGATION, 0, toxicity.REPORT, toxicity.INSULT, 0, 0, toxicity.INSULT]
    sa = sb = s = 0
    for w in words:
        assert abs(both.weight[s][w] - a.weight[sa][w] * b.weight[sb][w]) < 1e-12
        sa, sb, s = a.step[sa][w], b.step[sb][w], both.step[s][w]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    hit = sum(r.predicted for r in held if r.toxic) / max(1, sum(r.toxic for r in held))
    false = sum(r.predicted for r in held if not r.toxic) / sum(1 - r.toxic for r in held)
    assert hit > 0.9 and false < 0.02


def test_toxicity_awkward_rows(spark):
    df = C.docs(spark)
    labels = spark.createDataFrame([(11, 1), (1, 0), (3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    rows = toxicity.scored(df, model).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id in (4, 5)}
    assert len(same) == 1  # null and empty alike
    by = {r.doc_id: r.score for r in rows}
    assert by[11] > by[1]
    assert toxicity.with_score(df, model, "s").columns == [*df.columns, "s"]
    assert toxicity.scored(C.empty_docs(spark), toxicity.fit(C.empty_docs(spark), labels)).collect() == []


def test_labels_of_held_out_rows_do_not_matter(spark):
    sf = C.SMALL
    docs, labels = C.table(spark, "documents"), C.table(spark, "labels")
    a = toxicity.scored(docs, toxicity.fit(docs, labels))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = toxicity.scored(docs, toxicity.fit(docs, flipped))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())), sf


def test_language_held_out(spark):
    rows = QUERIES["op8_language"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward_rows(spark):
    df = C.docs(spark)
    rows = langid.predict(df, langid.prototypes(df)).collect()
    assert len(rows) == df.count()
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[4] == by[5] == by[6] == by[10] == "und" and by[1] == "en"
    assert langid.predict(C.empty_docs(spark), {}).collect() == []
    assert {r.lang_pred for r in langid.predict(df, langid.prototypes(C.empty_docs(spark))).collect()} == {"und"}


def test_vectors_bind_and_bundle():
    import numpy as np
    space = langid.Space(256, 3, 1)
    data = np.frombuffer("abc bcd".encode(), np.uint8)
    vec, has = space.texts(data, np.array([0, 7]))
    want = np.zeros(256)
    text = [ord(c) for c in " abc bcd "]  # between edges
    for i in range(7):
        v = np.ones(256)
        for k in range(3):
            v *= np.roll(space.symbol(np.array([text[i + k]], np.uint64))[0], 2 - k)
        want += v
    assert has[0] and (vec[0] == want).all()
