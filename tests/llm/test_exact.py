import hashlib
import re

import duckdb

import llm_cases as C
from clickstack.llm import exact
from clickstack.llm.queries import ORACLE, QUERIES
from compare import rows_of


def brute(docs):
    """(id, keep, size, digest) per row and the number of kept rows per digest."""
    groups = {}
    for d, t in docs:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((-len(t or ""), d is None, d or 0, d))
    return sorted(((r[3] is None, r[3] or 0), str(min(g)[3]), len(g), h) for h, g in groups.items() for r in g), len(groups)


def found(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0), str(r.keep_id), r.group_size, r.digest) for r in rows)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{C.SMALL}/documents.parquet'")
    df, rel = QUERIES["op11_exact_dedup"](spark, C.SMALL), con.sql(ORACLE["op11_exact_dedup"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


AWKWARD = [(None, "a b"), (None, "ab"), (None, "a  b"), (3, "ab"), (3, "a  b"), (3, "a  b"), (4, None), (5, ""), (6, " \t\r\n\x0b\f"),
           (7, " "), (8, " "), (9, "x" * 200 + "y"), (10, "x" * 200 + "z"), (11, "x" * 200 + " y"), (1 << 62, "漢🙂 �"),
           (-(1 << 62), "漢🙂�"), (12, "a" + " " * 1_000_000 + "b")]


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string").selectExpr("*", *[f"'{c}' as {c}" for c in (
        "id", "norm", "row", "bit", "word", "mask", "full", "best", "kept", "carried", "group_size", "company")])
    df = df.unionByName(C.docs(spark).select("doc_id", "text"), allowMissingColumns=True)
    rows = exact.classes(df, digests=True).collect()
    want, n_groups = brute([(r.doc_id, r.text) for r in df.collect()])
    assert found(rows) == want
    kept = [r for r in rows if r.kept]
    assert len(kept) == n_groups and all(r.doc_id == r.keep_id for r in kept) and len({r.digest for r in kept}) == n_groups
    left = exact.without_copies(df)
    assert left.columns == df.columns and left.count() == n_groups
    assert exact.classes(df.where("false")).collect() == []


def test_only_texts_with_company_are_hashed(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    got = {(r.doc_id, r.digest is None) for r in exact.classes(df).collect()}
    assert (7, True) in got and (9, False) in got and (10, False) in got  # equal length and head
    size = {r.doc_id: r.group_size for r in exact.classes(df).collect()}
    assert size[9] == 2 and size[10] == 1 and size[7] == 1


def test_one_group_holds_most_rows(spark):
    df = spark.range(20_000).selectExpr("id doc_id", "case when id % 3 = 0 then 'one text' else concat('t', id % 5000) end text")
    rows = exact.classes(df).collect()
    assert sum(r.group_size == 6667 for r in rows) == 6667 and sum(r.kept for r in rows) == len({(r.digest or r.doc_id) for r in rows})
