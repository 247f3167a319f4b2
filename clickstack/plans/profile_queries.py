"""Registered profile and hash-diagnostic queries (2.4 #6-9, 2.1 #15, 2.7 #15-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as pr
from ..sources import fixtures as fx
from ..sources import shards as sh
from ..sources import tables as tb
from . import oracle_base as ob
from .registry import register

IT = [ob.IMPRESSIONS, ob.TRAIN]
# profile candidates = train columns minus label and sequence; integer-typed columns:
PROFILE_COLS = [("ID", False), ("rid", True), ("inventory_id", True), ("day_of_week", True),
                ("hour", True), ("feat_a_1", False), ("l_feat_14", False), ("user_id", True),
                ("k", True), ("value", False)]


def _profile_sql() -> str:
    parts = []
    for c, is_int in PROFILE_COLS:
        q = f'"{c}"'
        x = f"TRY_CAST({q} AS DOUBLE)"
        frac = "1.0" if is_int else f"coalesce(avg((abs(round({x}, 0) - {x}) <= 1e-6)::INT::DOUBLE), 0.0)"
        parts.append(f"""SELECT '{c}' AS col, {int(is_int)} AS is_int, count(*)::BIGINT AS "count",
       (count(*) - count({q}))::BIGINT AS null_count, count({q})::BIGINT AS non_null,
       (count(DISTINCT {q}) + CASE WHEN count(*) > count({q}) THEN 1 ELSE 0 END)::BIGINT AS n_unique,
       CASE WHEN count({q}) > 0 THEN (count(DISTINCT {q}) + CASE WHEN count(*) > count({q}) THEN 1 ELSE 0 END) / count({q}) ELSE 0.0 END AS unique_ratio,
       min({x}) AS num_min, max({x}) AS num_max, {frac} AS frac_int_like FROM train""")
    return "prof AS (" + " UNION ALL ".join(parts) + ")"


ROLES = """roles AS (SELECT col, n_unique,
  CASE WHEN non_null = 0 THEN 'empty' WHEN frac_int_like >= 0.999 OR is_int = 1 THEN 'int_like_categorical' ELSE 'continuous' END AS inferred,
  CASE WHEN non_null > 0 AND (frac_int_like >= 0.999 OR is_int = 1) THEN (n_unique + 2 + greatest(floor(n_unique * 0.02), 1000))::BIGINT END AS rec_vocab,
  CASE WHEN non_null > 0 AND (frac_int_like >= 0.999 OR is_int = 1) THEN greatest(8, least(64, ceil(sqrt(greatest(n_unique, 2)))))::INT END AS rec_emb_dim,
  CASE WHEN non_null > 0 AND (frac_int_like >= 0.999 OR is_int = 1) THEN ((n_unique + 2 + greatest(floor(n_unique * 0.02), 1000)) * greatest(8, least(64, ceil(sqrt(greatest(n_unique, 2))))))::BIGINT END AS est_emb_params,
  concat_ws(';',
    CASE WHEN non_null = 0 THEN 'all_null' END,
    CASE WHEN non_null > 0 AND (frac_int_like >= 0.999 OR is_int = 1) AND unique_ratio > 0.5 THEN 'very_high_unique_ratio' END,
    CASE WHEN non_null > 0 AND (frac_int_like >= 0.999 OR is_int = 1) AND n_unique <= 2 THEN 'binary_like' END,
    CASE WHEN non_null > 0 AND NOT (frac_int_like >= 0.999 OR is_int = 1) AND num_min IS NOT NULL AND num_max IS NOT NULL
              AND num_max - num_min <> 0 AND unique_ratio < 0.001 THEN 'low_unique_ratio_continuous' END) AS notes
FROM prof)"""


def profile(spark, sf_dir):
    tr = fx.train(spark, sf_dir)
    return pr.column_profile(tr, pr.candidate_columns(tr, "clicked", "seq"))


@register("column_profile", ob.query(IT + [_profile_sql()], "SELECT * FROM prof",
                                     ["unique_ratio", "num_min", "num_max", "frac_int_like"]))
def q_column_profile(spark, sf_dir):
    """Statistics of every candidate column from its distinct values (2.4 #8)."""
    return profile(spark, sf_dir)


@register("column_roles", ob.query(IT + [_profile_sql(), ROLES], "SELECT * FROM roles"))
def q_column_roles(spark, sf_dir):
    """Role, vocab = n+2+max(2% n, 1000), sqrt embedding-dim rule (2.4 #9, 2.7 #15)."""
    return pr.column_roles(profile(spark, sf_dir))


@register("column_suggestions", ob.query(IT + [_profile_sql(), ROLES], """SELECT col,
  CASE WHEN inferred = 'int_like_categorical' THEN 'cat_include' ELSE 'dense_include' END AS suggestion,
  n_unique, rec_vocab, rec_emb_dim, est_emb_params, notes FROM roles WHERE inferred <> 'empty'"""))
def q_column_suggestions(spark, sf_dir):
    """cat_include / dense_include suggestions from the roles, written as the profile CSV and
    read back (2.1 #15)."""
    out = pr.column_suggestions(pr.column_roles(profile(spark, sf_dir)))
    path = sh.scratch_path(spark, "profile")
    tb.write_csv(out, path)
    back = spark.read.option("header", True).schema(out.schema).csv(path)
    return back.withColumn("notes", F.coalesce("notes", F.lit("")))


@register("key_cardinality", ob.query(IT + [ob.TEST], """SELECT
  (SELECT count(DISTINCT inventory_id) + max((inventory_id IS NULL)::INT) FROM (SELECT inventory_id FROM train UNION ALL SELECT inventory_id FROM test))::BIGINT AS n_inventory_id,
  (SELECT count(DISTINCT l_feat_14) + max((l_feat_14 IS NULL)::INT) FROM train)::BIGINT AS n_l_feat_14,
  (SELECT count(DISTINCT l_partkey) + max((l_partkey IS NULL)::INT) FROM lineitem)::BIGINT AS n_l_partkey,
  (SELECT count(DISTINCT o_custkey) + max((o_custkey IS NULL)::INT) FROM orders)::BIGINT AS n_o_custkey"""))
def q_key_cardinality(spark, sf_dir):
    """Distinct keys (null counted once) over one or several sources (2.4 #6)."""
    keys = tb.union_frames([fx.train(spark, sf_dir), fx.test(spark, sf_dir)], "inventory_id")
    a = keys.agg(pr.key_cardinality("inventory_id")).scalar()
    b = fx.train(spark, sf_dir).agg(pr.key_cardinality("l_feat_14")).scalar()
    li = tb.read_table(spark, sf_dir, "lineitem")
    c = li.agg(pr.key_cardinality("l_partkey")).scalar()
    o = tb.read_table(spark, sf_dir, "orders")
    d = o.agg(pr.key_cardinality("o_custkey")).scalar()
    return spark.range(1).select(a.alias("n_inventory_id"), b.alias("n_l_feat_14"),
                                 c.alias("n_l_partkey"), d.alias("n_o_custkey"))


MS = [100, 500, 1000, 2000, 5000, 20000, 200000]


@register("hash_collisions", ob.query([], " UNION ALL ".join(
    f"""SELECT {m} AS m, n_unique, ub AS unique_buckets, 1.0 - ub / greatest(n_unique, 1) AS collision_ratio,
       ((1.0 - ub / greatest(n_unique, 1)) <= 0.005)::INT AS passes FROM (
  SELECT (count(DISTINCT k) + max((k IS NULL)::INT))::BIGINT AS n_unique,
         count(DISTINCT {ob.md5_u32("coalesce(k, 'NA')")} % {m})::BIGINT AS ub
  FROM (SELECT CAST(l_partkey AS VARCHAR) AS k FROM lineitem))""" for m in MS), ["collision_ratio"]))
def q_hash_collisions(spark, sf_dir):
    """Distinct buckets per candidate m in one aggregation, collision ratio (2.4 #7)."""
    li = tb.read_table(spark, sf_dir, "lineitem")
    return pr.hash_collisions(li, "l_partkey", MS)


# the load by bisection, in SQL: 1 - (1 - exp(-x)) / x = 0.005
LOAD = """WITH RECURSIVE b(i, lo, hi) AS (SELECT 0, 1e-9::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN 1 - (1 - exp(-(lo + hi) / 2)) / ((lo + hi) / 2) < 0.005 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN 1 - (1 - exp(-(lo + hi) / 2)) / ((lo + hi) / 2) < 0.005 THEN hi ELSE (lo + hi) / 2 END
  FROM b WHERE i < 60),
n AS (SELECT (count(DISTINCT l_partkey) + max((l_partkey IS NULL)::INT))::BIGINT AS n_unique FROM lineitem)
SELECT n_unique, 0.005::DOUBLE AS target_ratio,
       (ceil(n_unique / hi / 500000.0) * 500000)::BIGINT AS recommended_m,
       (ceil(n_unique / hi / 1000.0) * 1000)::BIGINT AS recommended_m_fine
FROM n, b WHERE i = 60"""


@register("recommend_buckets", LOAD)
def q_recommend_buckets(spark, sf_dir):
    """Least m, in units of 500k and of 1k, that keeps expected collisions to 0.5% (2.7 #16)."""
    n = tb.read_table(spark, sf_dir, "lineitem").agg(pr.key_cardinality("l_partkey").cast("long").alias("n_unique"))
    c = F.col("n_unique")
    return n.select("n_unique", F.lit(0.005).alias("target_ratio"), pr.recommended_buckets(c, 0.005).alias("recommended_m"),
                    pr.recommended_buckets(c, 0.005, unit=1000).alias("recommended_m_fine"))
