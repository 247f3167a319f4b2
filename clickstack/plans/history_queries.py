"""Registered history-pooling queries (2.11, 2.7 #9-10, 2.5 #7, 2.12 #1)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import history as hi
from ..sources import fixtures as fx
from ..sources import tables as tb
from . import oracle_base as ob
from .registry import register

# Fixture lookups into the one embedding table: token t -> vec t (attention) and t + 450
# (representation; beyond the table's end at the small scale factors, so the zero vector
# acts); inventory i -> 200 + i; day d -> 300 + d; hour h -> 400 + h.  max_len is below
# the longest history, so the cut acts.
MAX_LEN = 60
SPEC = hi.HistorySpec(max_len=MAX_LEN, top_k=8, tau=512.0, query_mode="concat", query_key="inventory_id", dim=64,
                      context_cols=("day_of_week", "hour"), att_offset=0, rep_offset=450,
                      query_offset=200, context_offsets={"day_of_week": 300, "hour": 400})


def _rows(spark, sf_dir):
    emb = tb.read_table(spark, sf_dir, "embeddings")
    return fx.impressions(spark, sf_dir).select("rid", "seq", "inventory_id", "day_of_week", "hour"), emb


def _pair(a: str, b: str, f: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: {f.replace('A', a + '[i]').replace('B', b + '[i]')})"


QV = f"""emb AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
qv0 AS (SELECT i.rid, i.seq, s1.v AS s1, {_pair('c1.v', 'c2.v', '(A + B) / 2.0')} AS s2
        FROM impressions i LEFT JOIN emb s1 ON s1.vec_id = i.inventory_id + 200
        LEFT JOIN emb c1 ON c1.vec_id = i.day_of_week + 300 LEFT JOIN emb c2 ON c2.vec_id = i."hour" + 400),
qv AS (SELECT rid, seq, s1, s2, {_pair('s1', 's2', '(A + B) * 0.5')} AS q FROM qv0)"""
SC = QV + f""",
tk AS (SELECT rid, q, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos, len(l) AS "L"
       FROM (SELECT rid, q, {ob.lenient_tail('seq', MAX_LEN)} AS l FROM qv)),
sc AS (SELECT rid, pos, token, coalesce(list_dot_product(a.v, q), 0.0) + ln(exp(-("L" - 1 - pos) / 512.0) + 1e-8) AS score,
              coalesce(r.v, list_transform(range(64), lambda x: 0.0::DOUBLE)) AS rep
       FROM tk LEFT JOIN emb a ON a.vec_id = token LEFT JOIN emb r ON r.vec_id = token + 450 WHERE token IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, pos) AS "rank" FROM sc QUALIFY "rank" <= 8)"""


def _long(df, keep, vectors):
    """One row per dimension."""
    z = F.arrays_zip(*[F.col(c) for c in vectors])
    e = df.select(*keep, F.posexplode(z).alias("d", "_z"))
    return e.select(*keep, (F.col("d") + 1).alias("d"), *[F.col(f"_z.{c}").alias(c) for c in vectors])


@register("query_vector", ob.query([ob.IMPRESSIONS, QV], """SELECT rid, generate_subscripts(q, 1)::INT AS d, unnest(s1) AS s1,
       unnest(s2) AS s2, unnest(q) AS "concat" FROM qv""", ["s1", "s2", '"concat"']))
def q_query_vector(spark, sf_dir):
    """Query vector modes S1 (target embedding), S2 (mean of context embeddings) and
    concat (their average), all dimensions, from one pass (2.11 #2)."""
    rows, emb = _rows(spark, sf_dir)
    return _long(hi.with_query_vectors(rows, emb, SPEC), ["rid"], ["s1", "s2", "concat"])


@register("history_score", ob.query([ob.IMPRESSIONS, SC], "SELECT rid, pos::INT AS pos, token::INT AS token, score FROM sc",
                                     ["score"]))
def q_history_score(spark, sf_dir):
    """Recency-aware dot score of every kept history token (2.7 #9, 2.11 #1)."""
    return hi.token_scores(*_rows(spark, sf_dir), SPEC).select("rid", "pos", "token", "score")


@register("history_topk", ob.query([ob.IMPRESSIONS, SC], """SELECT rid, "rank"::INT AS "rank", pos::INT AS pos,
       token::INT AS token, score FROM top""", ["score"]))
def q_history_topk(spark, sf_dir):
    """Per-row top-8 tokens by score, ties to the older position (2.5 #7)."""
    return hi.top_k(*_rows(spark, sf_dir), SPEC)


def _pool_sql(weight: str) -> str:
    return ob.query([ob.IMPRESSIONS, SC + f""",
w AS (SELECT rid, rep, {weight} AS w FROM top),
dims AS (SELECT rid, w, unnest(rep) AS v, generate_subscripts(rep, 1) AS d FROM w),
pv AS (SELECT rid, d, sum(w * v) AS pooled FROM dims GROUP BY rid, d),
ns AS (SELECT rid, count(*) AS n_sel FROM top GROUP BY rid)"""],
        """SELECT i.rid, coalesce(n_sel, 0)::BIGINT AS n_sel, g.range::INT AS d, coalesce(pooled, 0.0) AS pooled
FROM impressions i, range(1, 65) g LEFT JOIN pv ON pv.rid = i.rid AND pv.d = g.range LEFT JOIN ns ON ns.rid = i.rid""", ["pooled"])


@register("history_pool", _pool_sql("exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY rid)").replace(
    "FROM top),", "FROM (SELECT *, max(score) OVER (PARTITION BY rid) AS m FROM top)),", 1))
def q_history_pool(spark, sf_dir):
    """Softmax over the top-8 scores, weighted sum of representation vectors, all dimensions;
    empty history -> zero vector (2.7 #10, 2.11 #3)."""
    return _long(hi.pool(*_rows(spark, sf_dir), SPEC), ["rid", "n_sel"], ["pooled"])


@register("history_pool_relu", _pool_sql("greatest(score, 0) / (sum(greatest(score, 0)) OVER (PARTITION BY rid) + 1e-12)"))
def q_history_pool_relu(spark, sf_dir):
    """The relu gate: positive scores, normalised (2.7 #10)."""
    spec = replace(SPEC, gating="relu")
    return _long(hi.pool(*_rows(spark, sf_dir), spec), ["rid", "n_sel"], ["pooled"])


@register("fm_interaction", ob.query([ob.IMPRESSIONS, """emb AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
fv AS (SELECT i.rid, a.v AS a, b.v AS b, c.v AS c FROM impressions i
       JOIN emb a ON a.vec_id = i.inventory_id + 200 JOIN emb b ON b.vec_id = i.day_of_week + 300
       JOIN emb c ON c.vec_id = i."hour" + 400)"""],
    """SELECT rid, 0.5 * list_sum(list_transform(range(1, len(a) + 1),
       lambda i: (a[i] + b[i] + c[i]) * (a[i] + b[i] + c[i]) - (a[i] * a[i] + b[i] * b[i] + c[i] * c[i]))) AS fm FROM fv""",
    ["fm"]))
def q_fm_interaction(spark, sf_dir):
    """(sum v)^2 - sum v^2 over the row's category vectors, as a column expression (2.12 #1)."""
    emb = tb.read_table(spark, sf_dir, "embeddings")
    df = fx.impressions(spark, sf_dir).select("rid", "inventory_id", "day_of_week", "hour")
    for key, offset, out in (("inventory_id", 200, "_a"), ("day_of_week", 300, "_b"), ("hour", 400, "_c")):
        df = hi.with_vector(df, emb, offset, key, out, SPEC.dim)
    return df.select("rid", hi.fm_interaction(["_a", "_b", "_c"], SPEC.dim).alias("fm"))
