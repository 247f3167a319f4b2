"""Registered covis queries over the impressions fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import parse_lenient, recency_weight, tail, time_bin, valid_positions
from ..operators import covis as cv
from ..operators import features as fe
from ..operators.folds import attach_folds, group_folds
from ..sources import fixtures as fx
from ..sources import shards as sh
from . import oracle_base as ob
from .registry import register

# Fixture settings: target l_feat_14, time bin day_of_week, folds over
# inventory_id x day_of_week (portable md5 hashing so DuckDB can check it).
# The kept tail is shorter than the longest history, so the cut acts; every token 7 is
# turned into junk, so junk positions are exercised too.
K = 60
SPEC = cv.CovisSpec(targets=("l_feat_14",), time_bin="day_of_week", seq_top_k=K,
                    fold_group=("inventory_id", "day_of_week"))
SPEC2 = cv.CovisSpec(targets=("l_feat_14", "hour"), time_bin="day_of_week", seq_top_k=K,
                     fold_group=("inventory_id", "day_of_week"))
HASH = "md5"
FEATS = SPEC.feature_columns()
FEATS2 = SPEC2.feature_columns()


def with_junk(df):
    return df.withColumn("seq", F.regexp_replace("seq", r"\b7\b", "x"))


def train_rows(spark, sf_dir):
    return with_junk(fx.train(spark, sf_dir))


def test_rows(spark, sf_dir):
    return with_junk(fx.test(spark, sf_dir))


def train_with_folds(spark, sf_dir):
    return attach_folds(train_rows(spark, sf_dir), list(SPEC.fold_group), SPEC.n_folds, HASH)


JUNK = r"SELECT * REPLACE (regexp_replace(seq, '\b7\b', 'x', 'g') AS seq)"
IMP = "impj AS (" + JUNK + " FROM impressions)"
TRAIN, TEST = ob.TRAIN.replace("impressions", "impj"), ob.TEST.replace("impressions", "impj")
BASE = [ob.IMPRESSIONS, IMP, TRAIN, TEST, ob.folds_cte()]
TOK_TRAIN = ob.tokens_cte("tok", "trainf", ["rid", "fold", "clicked"], ["l_feat_14"],
                          "day_of_week", K, 512, outer=False)
FOLDS = "folds_list AS (SELECT range::INT AS f FROM range(5))"
PAIR_FULL = f"""pair_full AS (
  SELECT target, target_value, token::INT AS token, time_bin::INT AS time_bin,
         count(*)::BIGINT AS impr, sum(clicked)::BIGINT AS clicks, sum(w_rec) AS w_rec_sum,
         max(pos)::INT AS max_pos
  FROM tok GROUP BY ALL),
p0_full AS (SELECT coalesce(avg(clicked), 0.019) AS p0 FROM tok),
pair_full_c AS (
  SELECT s.*, {ob.smooth('clicks', 'impr', 'p0')} AS ctr, (impr < 10)::INT AS is_lowcount
  FROM pair_full s, p0_full)"""
PAIR_OOF = f"""pair_oof_raw AS (
  SELECT f.f AS fold, target, target_value, token::INT AS token, time_bin::INT AS time_bin,
         count(*)::BIGINT AS impr, sum(clicked)::BIGINT AS clicks, sum(w_rec) AS w_rec_sum,
         max(pos)::INT AS max_pos
  FROM tok JOIN folds_list f ON tok.fold <> f.f GROUP BY ALL),
p0_oof AS (SELECT f.f AS fold, coalesce(avg(clicked), 0.019) AS p0
           FROM tok JOIN folds_list f ON tok.fold <> f.f GROUP BY f.f),
pair_oof AS (
  SELECT s.*, {ob.smooth('clicks', 'impr', 'p0')} AS ctr, (impr < 10)::INT AS is_lowcount
  FROM pair_oof_raw s JOIN p0_oof USING (fold))"""


def row_agg_sql(targets, n=3):
    out = []
    for t in targets:
        c = f"CASE WHEN target = '{t}' THEN ctr END"
        w = f"CASE WHEN target = '{t}' THEN w_rec END"
        i = f"CASE WHEN target = '{t}' THEN coalesce(impr, 0)::DOUBLE END"
        top = (f"list_avg(list_slice(list_sort(list({c}) FILTER (WHERE ({c}) IS NOT NULL), 'DESC'), 1, {n}))")
        out += [
            f"coalesce(sum({c}), 0.0)::DOUBLE AS {t}_sum_ctr",
            f"coalesce(avg({c}), 0.0)::DOUBLE AS {t}_mean_ctr",
            f"coalesce(max({c}), 0.0)::DOUBLE AS {t}_max_ctr",
            f"coalesce({top}, 0.0)::DOUBLE AS {t}_top{n}_mean_ctr",
            f"coalesce(coalesce(sum(({c}) * ({w})), 0.0) / sum({w}), 0.0)::DOUBLE AS {t}_wmean_ctr",
            f"coalesce(sum({i}), 0.0)::DOUBLE AS {t}_sum_impr",
            f"coalesce(max({i}), 0.0)::DOUBLE AS {t}_max_impr",
            f"coalesce(sqrt(avg(({c}) * ({c}))), 0.0)::DOUBLE AS {t}_pnorm_ctr",
        ]
    return ",\n  ".join(out)


ROWTOK_TRAIN = ob.tokens_cte("rtok", "trainf", ["rid", "fold"], ["l_feat_14"], "day_of_week",
                             K, 512, outer=True)
ROWTOK_TEST = ob.tokens_cte("ttok", "test", ['"ID"'], ["l_feat_14"], "day_of_week",
                            K, 512, outer=True)
RF_OOF = f"""rf_oof AS (
  SELECT rid, fold, {row_agg_sql(['l_feat_14'])}
  FROM rtok LEFT JOIN pair_oof USING (target, target_value, token, time_bin, fold)
  GROUP BY rid, fold)"""
RF_TEST = f"""rf_test AS (
  SELECT "ID", {row_agg_sql(['l_feat_14'])}
  FROM ttok LEFT JOIN pair_full_c USING (target, target_value, token, time_bin)
  GROUP BY "ID")"""


# ---------------------------------------------------------------- pair statistics
@register("pair_stats_full", ob.query(BASE + [TOK_TRAIN, PAIR_FULL],
          "SELECT * FROM pair_full_c", ["w_rec_sum", "ctr"]))
def q_pair_stats_full(spark, sf_dir):
    """Pair statistics over all training rows (2.4 #2-3, 2.7 #11-12)."""
    tok = cv.token_rows(train_with_folds(spark, sf_dir), SPEC, keep=["fold", "clicked"])
    return cv.pair_stats_full(tok, SPEC).withColumn("is_lowcount", F.col("is_lowcount").cast("int"))


@register("pair_stats_oof", ob.query(BASE + [TOK_TRAIN, FOLDS, PAIR_OOF],
          "SELECT * FROM pair_oof", ["w_rec_sum", "ctr"]))
def q_pair_stats_oof(spark, sf_dir):
    """Out-of-fold pair statistics by subtraction, one scan for all folds (2.4 #2, #5)."""
    tok = cv.token_rows(train_with_folds(spark, sf_dir), SPEC, keep=["fold", "clicked"])
    out = cv.pair_stats_oof(tok, SPEC).withColumn("is_lowcount", F.col("is_lowcount").cast("int"))
    return out.select("fold", *cv.KEYS, "impr", "clicks", "w_rec_sum", "max_pos", "ctr", "is_lowcount")


@register("smoothed_ctr", ob.query(
    [ob.IMPRESSIONS, IMP, TRAIN,
     ob.tokens_cte("tokh", "train", ["rid", "clicked"], ["inventory_id"], '"hour"', K, 512, False),
     f"""ph AS (SELECT target, target_value, token::INT AS token, time_bin::INT AS time_bin,
                count(*)::BIGINT AS impr, sum(clicked)::BIGINT AS clicks FROM tokh GROUP BY ALL),
     p0h AS (SELECT avg(clicked) AS p0 FROM tokh)"""],
    f"SELECT target, target_value, token, time_bin, impr, clicks, "
    f"{ob.smooth('clicks', 'impr', 'p0', 20.0, 0.01, 0.99)} AS ctr FROM ph, p0h", ["ctr"]))
def q_smoothed_ctr(spark, sf_dir):
    """Beta-smoothed, clipped rate with another prior strength, clip and time bin
    (target inventory_id by hour; no folds involved)."""
    spec = cv.CovisSpec(targets=("inventory_id",), time_bin="hour", prior_strength=20.0,
                        ctr_clip=(0.01, 0.99), seq_top_k=K)
    tok = cv.token_rows(train_rows(spark, sf_dir), spec, keep=["clicked"])
    return cv.pair_stats_full(tok, spec).select(*cv.KEYS, "impr", "clicks", "ctr")


# ---------------------------------------------------------------- row features
@register("row_features_oof", ob.query(BASE + [TOK_TRAIN, FOLDS, PAIR_OOF, ROWTOK_TRAIN, RF_OOF],
          "SELECT * FROM rf_oof", FEATS))
def q_row_features_oof(spark, sf_dir):
    """Flagship: out-of-fold row features for every training row (2.4 #4)."""
    tr = cv.parsed(train_with_folds(spark, sf_dir), SPEC)
    return cv.row_features_oof(tr, cv.stored(cv.pair_stats_of_rows(tr, SPEC)), SPEC, ["rid", "fold"])


@register("row_features_test", ob.query(BASE + [TOK_TRAIN, PAIR_FULL, ROWTOK_TEST, RF_TEST],
          "SELECT * FROM rf_test", FEATS))
def q_row_features_test(spark, sf_dir):
    """Test rows scored against the full-train pair statistics."""
    tok = cv.token_rows(train_with_folds(spark, sf_dir), SPEC, keep=["fold", "clicked"])
    full = cv.pair_stats_full(tok, SPEC)
    return cv.row_features(test_rows(spark, sf_dir), full, SPEC, ["ID"])


TOK2 = ob.tokens_cte("tok", "trainf", ["rid", "fold", "clicked"], ["l_feat_14", "hour"],
                     "day_of_week", K, 512, outer=False)
ROWTOK2 = ob.tokens_cte("rtok", "trainf", ["rid", "fold"], ["l_feat_14", "hour"], "day_of_week",
                        K, 512, outer=True)


@register("row_features_multi_target", ob.query(
    BASE + [TOK2, FOLDS, PAIR_OOF,
            ROWTOK2,
            f"""rf2 AS (SELECT rid, {row_agg_sql(['l_feat_14', 'hour'])}
              FROM rtok LEFT JOIN pair_oof USING (target, target_value, token, time_bin, fold)
              GROUP BY rid)"""],
    "SELECT * FROM rf2", FEATS2))
def q_row_features_multi_target(spark, sf_dir):
    """Two targets stacked as rows: one shuffle for both, one row per rid (2.3 #6)."""
    tr = cv.parsed(train_with_folds(spark, sf_dir), SPEC2)
    return cv.row_features_oof(tr, cv.stored(cv.pair_stats_of_rows(tr, SPEC2)), SPEC2, ["rid"])


# ---------------------------------------------------------------- joins back to rows
MED = """med AS (SELECT coalesce(median(feat_a_1) FILTER (WHERE NOT isnan(feat_a_1)), 0.0) AS m FROM train)"""


CACHE = fe.FeatureSpec(num_patterns=("feat_*",), hash_mode="md5", max_len=K)


def _f32(x: str, name: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE) AS {name}"


@register("features_with_covis", ob.query(
    BASE + [TOK_TRAIN, FOLDS, PAIR_OOF, ROWTOK_TRAIN, RF_OOF, MED],
    f"""SELECT t.rid, t.clicked::TINYINT AS y,
       {_f32("CASE WHEN t.feat_a_1 IS NULL OR isnan(t.feat_a_1) THEN med.m ELSE t.feat_a_1 END", "feat_a_1")},
       (t.feat_a_1 IS NULL OR isnan(t.feat_a_1))::TINYINT AS feat_a_1_mask,
       {', '.join(_f32(f"coalesce(r.{c}, 0.0)", c) for c in FEATS)}
FROM trainf t LEFT JOIN rf_oof r USING (rid), med""", ["feat_a_1"] + FEATS))
def q_features_with_covis(spark, sf_dir):
    """OOF features joined on rid become numerics of the block (filled with 0.0); the block is
    written as a sharded cache and read back (2.1 #9, 2.2 #10, 2.3 #1)."""
    tr = cv.parsed(train_with_folds(spark, sf_dir), SPEC)
    rf = cv.row_features_oof(tr, cv.stored(cv.pair_stats_of_rows(tr, SPEC)), SPEC, ["rid"])
    # the fills of the table's own numerics need no joined column: there is one line of features per rid
    plain = tr.drop("seq")
    fitted = fe.fit(plain.select("*", *[F.lit(0.0).alias(c) for c in FEATS]), CACHE, tuple(FEATS))
    rows = cv.join_features(plain, rf, "rid", FEATS)
    _, block = sh.write_block(fe.transform(rows, fitted), sh.scratch_path(spark, "covis-cache"), 700)
    nums = [F.element_at("X_num", i + 1).cast("double").alias(c) for i, c in enumerate(fitted.num_cols)]
    return block.select("rid", "y", F.element_at("X_mask", 1).alias("feat_a_1_mask"), *nums)


@register("test_features_with_covis", ob.query(
    BASE + [TOK_TRAIN, PAIR_FULL, ROWTOK_TEST, RF_TEST],
    f"""SELECT t."ID", t.rid, {', '.join(f'coalesce(r.{c}, 0.0) AS {c}' for c in FEATS)}
FROM test t LEFT JOIN rf_test r USING ("ID")""", FEATS))
def q_test_features_with_covis(spark, sf_dir):
    """Test rows left-joined with full-train features on ID; misses -> 0.0 (2.3 #2-3)."""
    te = test_rows(spark, sf_dir)
    tok = cv.token_rows(train_with_folds(spark, sf_dir), SPEC, keep=["fold", "clicked"])
    rf = cv.row_features(te, cv.pair_stats_full(tok, SPEC), SPEC, ["ID"])
    return cv.join_features(te.select("ID", "rid"), rf, "ID", FEATS)


@register("pair_lookup", ob.query(
    BASE + [TOK_TRAIN, PAIR_FULL, ROWTOK_TEST],
    """SELECT "ID", pos::INT AS pos, token::INT AS token, coalesce(impr, 0)::BIGINT AS impr, ctr
FROM ttok LEFT JOIN pair_full_c USING (target, target_value, token, time_bin)
WHERE token IS NOT NULL""", ["ctr"]))
def q_pair_lookup(spark, sf_dir):
    """Exploded test tokens left-joined to pair statistics; a null target never matches."""
    tok = cv.token_rows(train_with_folds(spark, sf_dir), SPEC, keep=["fold", "clicked"])
    full = cv.pair_stats_full(tok, SPEC).select(*cv.KEYS, "impr", "ctr")
    tt = cv.token_rows(test_rows(spark, sf_dir), SPEC, keep=["ID"])
    return cv.look_up(tt, full, ["impr", "ctr"]).select(
        "ID", "pos", "token", F.coalesce("impr", F.lit(0)).cast("long").alias("impr"), "ctr")


# ---------------------------------------------------------------- folds
@register("group_folds", ob.query(BASE, "SELECT rid, fold FROM trainf"))
def q_group_folds(spark, sf_dir):
    """Round-robin over sorted group hashes; every row gets its group's fold (2.8 #1)."""
    return group_folds(fx.train(spark, sf_dir), ["inventory_id", "day_of_week"], 5, HASH)


@register("fold_restrict", ob.query(
    BASE, "SELECT rid, clicked FROM train WHERE rid IN (SELECT rid FROM trainf WHERE fold = 0)"))
def q_fold_restrict(spark, sf_dir):
    """Validation rows of fold 0 through a left-semi join with the fold table (2.3 #9)."""
    tr = fx.train(spark, sf_dir)
    folds = group_folds(tr, ["inventory_id", "day_of_week"], 5, HASH)
    return tr.join(folds.where(F.col("fold") == 0), "rid", "left_semi").select("rid", "clicked")


# ---------------------------------------------------------------- sequence operators
@register("explode_positions", ob.query(
    [ob.IMPRESSIONS, IMP, ob.tokens_cte("tk", "impj", ["rid"], ["l_feat_14"], "day_of_week",
                                   K, 512, False)],
    "SELECT rid, pos::INT AS pos, token::INT AS token FROM tk"))
def q_explode_positions(spark, sf_dir):
    """Kept history as rows: position 0 = oldest kept token, junk not counted (2.5 #1, 2.7 #6)."""
    imp = with_junk(fx.impressions(spark, sf_dir)).select("rid", tail(parse_lenient(F.col("seq")), K).alias("l"))
    return imp.select("rid", F.inline(valid_positions("l")))


@register("seq_tail", ob.query(
    [ob.IMPRESSIONS],
    f"""SELECT rid, array_to_string({ob.lenient_tail('seq', 8)}, ',') AS seq_tail,
       len({ob.lenient_tail('seq', 8)})::INT AS n_tail FROM impressions"""))
def q_seq_tail(spark, sf_dir):
    """Last 8 tokens of the lenient parse (2.6 #2, 2.7 #5)."""
    t = tail(parse_lenient(F.col("seq")), 8)
    return fx.impressions(spark, sf_dir).select(
        "rid", F.array_join(t, ",").alias("seq_tail"), F.size(t).alias("n_tail"))


@register("recency_weights", ob.query(
    [ob.IMPRESSIONS, IMP, ob.tokens_cte("rw", "impj", ["rid", "seq"], ["l_feat_14"], "day_of_week", 400, 512, False)],
    f"""SELECT rid, pos::INT AS pos, exp(-pos / 512.0) AS w_start,
       exp(-(len(list_filter({ob.lenient_tail('seq', 400)}, lambda t: t IS NOT NULL)) - 1 - pos) / 512.0) AS w_end
FROM rw""", ["w_start", "w_end"]))
def q_recency_weights(spark, sf_dir):
    """exp(-pos/tau) with pos from the oldest (as coded) and from the newest token (2.7 #7)."""
    imp = with_junk(fx.impressions(spark, sf_dir))
    base = imp.select("rid", parse_lenient(F.col("seq")).alias("l"))
    e = base.select("rid", F.size(F.array_compact("l")).alias("n"), F.inline(valid_positions("l")))
    return e.select("rid", "pos", recency_weight(F.col("pos"), 512).alias("w_start"),
                    recency_weight(F.col("n") - 1 - F.col("pos"), 512).alias("w_end"))


@register("time_bin", ob.query(
    [ob.IMPRESSIONS],
    """SELECT rid, day_of_week AS tb_dow, "hour" AS tb_hour, (day_of_week * 24 + "hour")::INT AS tb_dow_hour
FROM impressions"""))
def q_time_bin(spark, sf_dir):
    """Time bin modes: one column as int, or dow*24+hour (2.7 #8)."""
    imp = fx.impressions(spark, sf_dir)
    return imp.select("rid", time_bin("day_of_week").alias("tb_dow"), time_bin("hour").alias("tb_hour"),
                      time_bin("day_of_week_hour").alias("tb_dow_hour"))
