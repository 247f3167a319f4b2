"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.shards import scratch_path
from . import decontam, exact, langid, packing, prefixtrie, quality, repair, simhash, spotsigs, suffix, toxicity, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict:
    """The byte-level vocabulary of 50k, as JSON and as ranks."""
    import public_tokenizers
    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}


@_query("op1_packing")
def op1(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), **tokenizer_files(), seq_len=2048, end_id=1)


@_query("op5_simhash")
def op5(spark, sf_dir):
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), width=3, max_bits=3)


@_query("op10_suffix_dedup")
def op10(spark, sf_dir):
    kept = suffix.kept_texts(_table(spark, sf_dir, "documents"), width=100)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return kept.select("doc_id", size.alias("n_bytes"),
                       (size - F.octet_length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query("op7_toxicity")
def op7(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query("op8_language")
def op8(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    models = langid.prototypes(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, models).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# The rules of the contract: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]

OP9_SQL = """
with u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end r
           from pages),
h as (select page_id, r, regexp_extract(r, '^[^/?#]*') h0 from u),
s as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') path from h),
rules(verdict, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (select page_id, host, path, rh || rp as rule, verdict,
             row_number() over (partition by page_id order by length(rh || rp) desc nulls last) k
      from s left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from m where k = 1
"""


@_query("op9_url_filter", OP9_SQL)
def op9(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules)


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (g[{i + 1}] // {1 << s}) % 32 + 1, 1)"
                   for i in range(8) for s in (15, 10, 5, 0))
OP3_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) h from pages),
m as (select *, max(page_id) over (partition by h) top,
             [('0x' || substr(h, 5 * i + 1, 5))::bigint for i in range(8)] g from p)
select page_id, payload_bytes, {_B32} payload_digest,
       case when page_id = top then 'response' else 'revisit' end record_type,
       case when page_id <> top then top end refers_to
from m
"""


@_query("op3_warc", OP3_SQL)
def op3(spark, sf_dir):
    path = scratch_path(spark, "archives")
    warc.write(_table(spark, sf_dir, "pages"), path)
    got = cut_lineage(warc.payloads(warc.reassembled(warc.read(spark, path))).select(
        F.col("page").cast("long").alias("page_id"), "record_id", "refers", F.col("type").alias("record_type"),
        F.octet_length("payload").cast("long").alias("n"), F.substring("digest", 6, 32).alias("payload_digest")), "pages-read")
    origin = got.where("record_type = 'response'").select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("n").alias("n_there"))
    return got.join(origin, "refers", "left").select(
        "page_id", F.coalesce("n", "n_there").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


@_query("op4_decontamination")
def op4(spark, sf_dir):
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=5, share=0.8)


@_query("op6_spotsigs")
def op6(spark, sf_dir):
    a, b, c = F.col("sigs"), F.col("edited_sigs"), F.col("next_sigs")
    return spotsigs.beside_next(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.fingerprint(a).alias("fingerprint"),
        spotsigs.fingerprint(b).alias("edited_fingerprint"), spotsigs.pruned_jaccard(a, b).alias("near_edited"),
        spotsigs.pruned_jaccard(a, c).alias("near_next"))


@_query("op2_quality")
def op2(spark, sf_dir):
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') t from documents),
s as (select doc_id, length(t) n, sha256(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) h from d),
k as (select *, first_value(doc_id) over w keep_id, row_number() over w = 1 kept, count(*) over (partition by h) group_size
      from s window w as (partition by h order by n desc, doc_id nulls last))
select doc_id, keep_id, group_size, kept, h text_sha256 from k
"""


@_query("op11_exact_dedup", OP11_SQL)
def op11(spark, sf_dir):
    return exact.classes(_table(spark, sf_dir, "documents"), digests=True).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string in SQL."""
    return (f"list_reduce(list_transform(range(0, length({text}) + 1), lambda i: case when i = 0 then 4294967295 else ascii({text}[i]) end), "
            "lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))")


def _edit(state: str, cost: str, initial: str, line: str | None = None, unless: str = "false") -> str:
    """A state after one more edit, null where that is not allowed."""
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"case when {unless} then null else {{'c': {state}.c + {cost}, 'w': {state}.w || '{initial}', 't': {lines}}} end"


def _inserted(q0: str, qs: str, qu: str, qa: str) -> str:
    """``qu`` and ``qa`` with inserted turns, as columns."""
    user = [_edit(x, "2", "I", "'user:'") for x in (q0, qs, qa)]
    return f"{q0} q0, {qs} qs, list_min([{qu}, {', '.join(user)}]) qu, {qa} qa0"


# Dynamic programming over (cost, initials, repaired lines) in the states nothing, system, user, assistant.
_FAR = "{'c': 1000000000, 'w': '', 't': []::varchar[]}"
_NO = "must or i <> '%s'"
OP12_SQL = f"""
with recursive d0 as (
  select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') key
  from conversations),
d1 as (select *, xor({_crc32("key")}, 4294967295) % 20 k from d0),
d2 as (select conv_id, turn, case when k = 4 then 'user' else r end r,
              case when k = 1 then '' when k = 2 then regexp_replace(x, '[.!?]', '', 'g') else x end x,
              unnest(case when k = 3 then [0, 1] else [0] end) as copy
       from d1 where k <> 0),
d3 as (select *, regexp_replace(x, '[\\x20\\x09-\\x0D]+$', '') solid,
              row_number() over (partition by conv_id order by turn nulls first, md5(octet_length(encode(r)) || ':' || r || x), copy) rn from d2),
d4 as (select *, solid = '' blank, solid <> '' and rn > min(rn) over (partition by conv_id, r, x) dup, r[1] i,
              lag(r[1]) over (partition by conv_id order by rn) before from d3),
d5 as (select *, blank or dup must, not blank and not dup and right(solid, 1) not in ('.', '!', '?') cut from d4),
st as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) gaps, count(*) filter (blank) blank, count(*) filter (dup) duplicate,
              count(*) filter (cut) truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) illegal, count(*) n
       from d5 group by conv_id),
dp as (
  select conv_id, 0::bigint n, q0, qs, qu, list_min([qa0, {_edit("qu", "2", "I", "'assistant:'")}]) qa
  from (select conv_id, {_inserted("z", "f", "f", "f")} from (select conv_id, {{'c': 0, 'w': '', 't': []::varchar[]}} z, {_FAR} f from st))
  union all
  select conv_id, n, q0, qs, qu, list_min([qa0, {_edit("qu", "2", "I", "'assistant:'")}]) qa
  from (select conv_id, n, {_inserted("a0", "a1", "a2", "a3")} from (
    select dp.conv_id, dp.n + 1 n, {_edit("q0", "3", "D")} a0,
           list_min([{_edit("qs", "3", "D")}, {_edit("q0", "cut::int", "K", "r || ':' || x", _NO % "s")}]) a1,
           list_min([{_edit("qu", "3", "D")}, {', '.join(_edit(q, "cut::int", "K", "r || ':' || x", _NO % "u") for q in ("q0", "qs", "qa"))},
                     {', '.join(_edit(q, "cut::int + 2", "R", "'user:' || x", "must") for q in ("q0", "qs", "qa"))}]) a2,
           list_min([{_edit("qa", "3", "D")}, {_edit("qu", "cut::int", "K", "r || ':' || x", _NO % "a")},
                     {_edit("qu", "cut::int + 2", "R", "'assistant:' || x", "must")}]) a3
    from dp join d5 on d5.conv_id is not distinct from dp.conv_id and d5.rn = dp.n + 1))),
best as (select conv_id, list_min([q0, qa]) b from dp join st using (conv_id, n))
select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
       coalesce(illegal, 0) illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.w, '') audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) c left join st on st.conv_id is not distinct from c.conv_id
     left join best on best.conv_id is not distinct from c.conv_id
"""


@_query("op12_repair", OP12_SQL)
def op12(spark, sf_dir):
    return repair.repaired(_table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
with k as (select conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) t, octet_length(encode(coalesce(text, ''))) b,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 pos
           from conversations),
cv as (select conv_id, count(*) n, xor({_crc32("(conv_id::varchar)")}, 4294967295) % 9 h, conv_id - conv_id % 5 base from k group by conv_id),
r as (select c.conv_id, p.pos + 1 depth, p.t, p.b from cv c join k p on p.conv_id = c.base and p.pos < c.h
      union all
      select c.conv_id, least(c.h, coalesce(o.n, 0)) + p.pos - c.h + 1, p.t, p.b
      from cv c join k p on p.conv_id = c.conv_id and p.pos >= c.h left join cv o on o.conv_id = c.base),
p as (select *, string_agg(t, '') over (partition by conv_id order by depth) path from r),
len as (select cv.conv_id, coalesce(max(depth), 0) len from cv left join r using (conv_id) group by cv.conv_id),
nodes as (select path, depth, min(conv_id) low, count(*) n, any_value(b) b, path[1:64 * (depth - 1)] up from p group by path, depth
          union all select '', 0, min(conv_id), count(*), 0, null from cv having count(*) > 0),
ch as (select up, count(*) n_children from nodes where up is not null group by up),
sub as (select a.path, sum((x.n - 1) * x.b)::bigint saved, count(*) filter (ch.up is null) n_leaves
        from nodes a join nodes x on starts_with(x.path, a.path) left join ch on ch.up = x.path group by a.path),
ends as (select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) sha
         from (select conv_id, path from p join len using (conv_id) where depth = len
               union all select conv_id, '' from len where len = 0) group by path)
select a.low conv_id, a.depth, u.low parent_conv_id, a.n n_convs, coalesce(ch.n_children, 0) n_children, sub.n_leaves,
       sub.saved saved_tokens, coalesce(ends.sha, sha256('')) ends_sha256
from nodes a left join nodes u on u.path = a.up left join ch on ch.up = a.path join sub on sub.path = a.path left join ends on ends.path = a.path
"""


@_query("op13_prefix_trie", OP13_SQL)
def op13(spark, sf_dir):
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))
