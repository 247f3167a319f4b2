import llm_cases as C
import corpus_pipeline as P
import test_decontam_quality_spots as D
import test_simhash as S
import test_suffix as X
from clickstack.llm import toxicity
from test_packing import check


def test_run_matches_stage_by_stage_brute_force(spark):
    """Each stage's output against a brute-force version of it on what the one before kept."""
    docs = C.table(spark, "documents")
    columns = docs.columns
    model = toxicity.fit(docs, C.table(spark, "labels"))
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    kept = {d: t for d, t in C.texts(spark) if score[d] < 0.3}
    out = P.drop_toxic(spark, docs, C.SMALL)
    assert out.columns == columns and {r.doc_id: r.text for r in out.collect()} == kept
    fps = [(d, S.brute_fp(t)) for d, t in kept.items()]
    kept = {d: kept[d] for (d, _), c in zip(fps, S.brute_groups(fps)) if c == d}
    cut = {}
    for d, (b, gone) in X.brute(list(kept.items())).items():
        cut[d] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore") if any(gone) else kept[d]
    items = [D.WORDS.findall(t.lower()) for _, t in C.texts(spark, "benchmark", "item_id")]
    for d in list(cut):
        w = D.WORDS.findall(cut[d].lower())
        mine = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
        if any(len({tuple(i[j:j + 5]) for j in range(len(i) - 4)} & mine) >= 0.8 * (len(i) - 4) for i in items if len(i) > 4):
            del cut[d]
    rows = P.run(spark, C.SMALL).collect()
    check(rows, list(cut.items()))


def test_stages_keep_columns_and_awkward_rows(spark):
    docs = C.docs(spark)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, C.SMALL)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.collect()}
        assert {8, 9, 7} <= ids, name
        assert stage(spark, docs.where("false"), C.SMALL).count() == 0, name
    assert P.STAGES[-1][1](spark, docs, C.SMALL).count() > 0
