import duckdb
import pytest

import llm_cases as C
from clickstack.llm import urlfilter, warc
from clickstack.llm.queries import ORACLE, QUERIES, URL_RULES
from compare import rows_of

URLS = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/x?y", "HTTPS://Www.Example.COM/en/1#t",
        "https://m.example.com/en/2", "https://www.example.com/en/", "http://x.net/es/ä", "http://net/fr/", "http://xnet/fr/",
        "http://a.b.c.net/fr", "http://.net/es/1", "a://b://c/d", "http://example.com?/en/", "http://ÄÖ.com/q", "http://x.com:80/"]


@pytest.mark.parametrize("key", ["op3_warc", "op9_url_filter"])
def test_queries_match_sql(spark, key):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{C.SMALL}/pages.parquet'")
    df, rel = QUERIES[key](spark, C.SMALL), con.sql(ORACLE[key])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def brute_rule(host, path):
    best = None
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return best or (None, "allow")


def test_urls_awkward(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, "http://")], "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    for most in (100, 1):  # by the digest array, by the join
        got = urlfilter.judge(pages, rules, max_rules=most).collect()
        assert len(got) == len(URLS) + 1
        for r in got:
            assert (r.host, r.path) == urlfilter.split_url(URLS[r.page_id])
            assert (r.rule, r.verdict) == brute_rule(r.host, r.path), (URLS[r.page_id], r, most)
    assert urlfilter.judge(pages.where("false"), rules).collect() == []
    assert {r.verdict for r in urlfilter.judge(pages, rules.where("false"), otherwise="block").collect()} == {"block"}


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    path = str(tmp_path / "x.idx")
    urlfilter.write_index(path, [("block", f"h{i}.org", "/") for i in range(50)])
    index = urlfilter.DigestArray(path)
    got = index.probe([f"h{i}.org/" for i in range(60)])
    assert (got[:50] >= 0).all() and (got[50:] == -1).all() and len(set(got[:50])) == 50


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", None), (3, None, "<p>same</p>"), (4, "http://a/4", ""),
         (5, "http://a/ 5", "é漢🙂" * 20_000), (6, "u", "x\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 300), (7, "u", "\r\n"), (8, "u", "<p>same</p>"),
         (8, "u", "<p>same</p>"), (9, "u", "a" * 4096), (10, "u", "b" * 16_384)]


@pytest.mark.parametrize("segment,chunk,least", [(16_384, 4096, 0), (50, 7, 5), (1_000_000, 100, 10**9)])
def test_archives_round_trip(spark, tmp_path, segment, chunk, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as number", "2 as payload")
    if segment == 50:
        pages = pages.where("page_id <> 5")
    path = str(tmp_path / "a")
    warc.write(pages, path, segment, chunk, least, per_file=7)
    got = warc.payloads(warc.reassembled(warc.read(spark, path))).collect()
    rows = [(p, (h or "").encode()) for p, _, h in PAGES if segment != 50 or p != 5]
    html = dict(rows)
    assert sorted(int(r.page) for r in got) == sorted(p for p, _ in rows)  # page 8 has two rows
    holder = {}
    for p, b in rows:
        if len(b) >= least:
            holder[b] = max(p, holder.get(b, p))
    for page, b in html.items():
        mine = [r for r in got if int(r.page) == page]
        response = len(b) < least or holder[b] == page
        assert sum(r.type == "response" for r in mine) == (len(mine) if len(b) < least else int(response))
        assert all(bytes(r.payload) == b if r.type == "response" else r.payload is None for r in mine)


def test_a_missing_segment_fails(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 1000)], "page_id long, url string, html string")
    path = str(tmp_path / "a")
    warc.write(pages, path, 100, 50)
    recs = warc.read(spark, path)
    for broken in (recs.where("segment <> 3"), recs.where("total is null"), recs.unionByName(recs.where("segment = 2"))):
        with pytest.raises(Exception, match="incomplete"):
            warc.reassembled(broken).collect()


def test_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = str(tmp_path / "a")
    warc.write(pages, path)
    assert warc.payloads(warc.reassembled(warc.read(spark, path))).collect() == []
