"""Registered scans, sinks and feature-block queries over the impressions fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import bucket, group_hash
from ..functions.sequence import left_pad, parse_strict
from ..operators import features as fe
from ..sources import fixtures as fx
from ..sources import shards as sh
from ..sources import tables as tb
from . import oracle_base as ob
from .registry import register

# Fixture feature settings (reference-style config, trimmed to the fixture columns).
SPEC = fe.FeatureSpec(
    cat_cols=("inventory_id", "day_of_week", "hour", "l_feat_14", "gender"),
    num_patterns=("feat_*", "val*", "k"),
    hash_buckets={"inventory_id": 1020, "day_of_week": 1009, "hour": 1026, "l_feat_14": 4239},
    hash_margin=500, hash_mode="md5", max_len=16, pad_id=0)
NUM = ["feat_a_1", "k", "value"]
SHARD_ROWS = 700
BATCH = 512

I = [ob.IMPRESSIONS]
IT = [ob.IMPRESSIONS, ob.TRAIN]
ITT = [ob.IMPRESSIONS, ob.TRAIN, ob.TEST]


def med_sql(src: str, cols: list[str]) -> str:
    parts = ", ".join(
        f"CASE WHEN median({c}::DOUBLE) IS NULL OR isnan(median({c}::DOUBLE)) THEN 0.0 "
        f"ELSE median({c}::DOUBLE) END AS m_{c}" for c in cols)
    return f"med AS (SELECT {parts} FROM {src})"


def miss_sql(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}::DOUBLE))"


def imp_sql(c: str, fill: str) -> str:
    return f"CASE WHEN {miss_sql(c)} THEN {fill} ELSE {c}::DOUBLE END"


def clamp_sql(x: str) -> str:
    return (f"CASE WHEN isnan({x}) THEN 0.0 WHEN {x} = 'inf'::DOUBLE THEN 1e6 "
            f"WHEN {x} = '-inf'::DOUBLE THEN -1e6 ELSE {x} END")


def strict_pad_sql(seq: str, n: int) -> str:
    lst = f"list_transform(list_filter(string_split(coalesce({seq}, ''), ','), lambda x: x <> ''), lambda x: x::INT)"
    t = f"(CASE WHEN len({lst}) > {n} THEN list_slice({lst}, len({lst}) - {n - 1}, len({lst})) ELSE {lst} END)"
    return f"list_concat(list_transform(range({n} - len({t})), lambda x: 0), {t})"


# ---------------------------------------------------------------- scans and sinks
@register("scan_projection", ob.query([], "SELECT event_id, user_id, value FROM events"))
def q_scan_projection(spark, sf_dir):
    """Lazy parquet scan; only the three projected columns reach ReadSchema (2.1 #1-2)."""
    return tb.read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")


@register("row_count", ob.query([], """SELECT (SELECT count(*) FROM events)::BIGINT AS n_events,
       (SELECT count(*) FROM lineitem)::BIGINT AS n_lineitem,
       (SELECT count(*) FROM orders)::BIGINT AS n_orders"""))
def q_row_count(spark, sf_dir):
    """Row counts: one aggregate per table, combined as scalar subqueries (2.1 #3)."""
    n = {t: tb.read_table(spark, sf_dir, t).agg(F.count(F.lit(1))).scalar()
         for t in ("events", "lineitem", "orders")}
    return spark.range(1).select(n["events"].alias("n_events"), n["lineitem"].alias("n_lineitem"),
                                 n["orders"].alias("n_orders"))


@register("union_key_sources", ob.query([], """SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM labels"""))
def q_union_key_sources(spark, sf_dir):
    """One key from several paths, as strings; a source without it is skipped with a warning
    (2.1 #4)."""
    return tb.union_key_sources(spark, [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels", "events")], "doc_id")


@register("prediction_scan", ob.query([ob.IMPRESSIONS, ob.MODEL_OUTPUTS, ob.PRED_TABLES],
                                      'SELECT "ID", clicked FROM pa', ["clicked"]))
def q_prediction_scan(spark, sf_dir):
    """Prediction table written as CSV to the shared folder and read back with ID as
    string (2.1 #5, #7)."""
    a, _ = fx.prediction_tables(spark, sf_dir)
    path = sh.scratch_path(spark, "pred")
    tb.write_csv(a, path)
    return tb.read_predictions(spark, path)


@register("submission_rows", ob.query([ob.IMPRESSIONS, ob.MODEL_OUTPUTS],
                                      """SELECT "ID", printf('%.8f', p1) AS clicked FROM mo"""))
def q_submission_rows(spark, sf_dir):
    """Submission CSV, written and read back: header ID,clicked, the probability printed '%.8f'
    (2.1 #6)."""
    mo = fx.model_outputs(spark, sf_dir)
    path = sh.scratch_path(spark, "submission")
    tb.write_submission(mo, path, "ID", "p1")
    return spark.read.option("header", True).schema("ID string, clicked string").csv(path)


# ---------------------------------------------------------------- row ids, shards, batches
CRID = "crid AS (SELECT *, row_number() OVER (ORDER BY rid) - 1 AS crid FROM train)"


def train_crid(spark, sf_dir):
    return fx.train(spark, sf_dir, numbered=True)


@register("contiguous_rid", ob.query(IT + [CRID], "SELECT rid, crid FROM crid"))
def q_contiguous_rid(spark, sf_dir):
    """Contiguous 0..N-1 index in input order, from file positions (2.5 #5)."""
    return train_crid(spark, sf_dir).select("rid", "crid")


@register("shard_manifest", ob.query(IT + [CRID], f"""SELECT (crid // {SHARD_ROWS})::INT AS shard,
       count(*)::BIGINT AS "rows", min(crid)::BIGINT AS start, (max(crid) + 1)::BIGINT AS "end"
FROM crid GROUP BY ALL"""))
def q_shard_manifest(spark, sf_dir):
    """Feature block written partitioned by shard; manifest read back from the files (2.1 #8)."""
    fitted = fe.fit(fx.train(spark, sf_dir), SPEC)
    block = fe.transform(train_crid(spark, sf_dir).drop("rid").withColumnRenamed("crid", "rid"), fitted)
    return sh.write_shards(block, sh.scratch_path(spark, "cache"), SHARD_ROWS)


@register("train_test_caches", ob.query(ITT, f"""SELECT split, (i // {SHARD_ROWS})::INT AS shard, count(*)::BIGINT AS "rows",
       min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS "end"
FROM (SELECT 'train' AS split, row_number() OVER (ORDER BY rid) - 1 AS i FROM train
      UNION ALL SELECT 'test', row_number() OVER (ORDER BY rid) - 1 FROM test) GROUP BY ALL"""))
def q_train_test_caches(spark, sf_dir):
    """One driver writes both caches and their manifests (2.1 #10)."""
    numbered = [d(spark, sf_dir, numbered=True).drop("rid").withColumnRenamed("crid", "rid") for d in (fx.train, fx.test)]
    a, b = sh.write_caches(*numbered, SPEC, sh.scratch_path(spark, "caches"), SHARD_ROWS, fit_on="each")
    return a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))


@register("row_locator", ob.query(IT + [CRID], f"""SELECT crid AS i, (crid // {SHARD_ROWS})::INT AS shard,
       (crid % {SHARD_ROWS})::BIGINT AS local FROM crid"""))
def q_row_locator(spark, sf_dir):
    """Global row index -> (shard, local) by an equi-join on the computed shard (2.1 #12, 2.3 #10)."""
    c = train_crid(spark, sf_dir).select(F.col("crid").alias("rid"))
    man = sh.manifest(sh.with_shard(c, SHARD_ROWS))
    return sh.locate(c.select(F.col("rid").alias("i")), man, SHARD_ROWS)


@register("batch_assembly", ob.query(IT + [CRID, med_sql("train", NUM)], f"""
SELECT (crid // {BATCH})::INT AS batch, (crid % {BATCH})::INT AS slot, clicked::FLOAT::DOUBLE AS y,
       {', '.join(f"CAST({clamp_sql(imp_sql(c, 'med.m_' + c))} AS FLOAT)::DOUBLE AS {c}" for c in NUM)},
       {', '.join(f"{miss_sql(c)}::INT::DOUBLE AS {c}_mask" for c in NUM)},
       {', '.join([f"{ob.bucket(c, SPEC.buckets(c))}::BIGINT AS {c}_bucket" for c in SPEC.cat_cols if c != 'gender'])},
       0::BIGINT AS gender_bucket, array_to_string({strict_pad_sql('seq', 16)}, ',') AS seq
FROM crid, med""", NUM))
def q_batch_assembly(spark, sf_dir):
    """Batches by floor(rid / batch_size) with every array of the block, widened as a training
    step reads them: numerics and masks float, categories and sequence long (2.1 #13)."""
    fitted = fe.fit(fx.train(spark, sf_dir), SPEC)
    block = fe.transform(train_crid(spark, sf_dir).drop("rid").withColumnRenamed("crid", "rid"), fitted)
    rid = F.col("rid")
    widened = block.select(
        F.floor(rid / F.lit(BATCH)).cast("int").alias("batch"), (rid % BATCH).cast("int").alias("slot"),
        F.col("y").cast("float").alias("y"), F.col("X_num").cast("array<float>").alias("num"),
        F.col("X_mask").cast("array<float>").alias("mask"), F.col("X_cat").cast("array<long>").alias("cat"),
        F.col("seq").cast("array<long>").alias("seq"))
    return widened.select(
        "batch", "slot", F.col("y").cast("double").alias("y"),
        *[F.element_at("num", i + 1).cast("double").alias(c) for i, c in enumerate(NUM)],
        *[F.element_at("mask", i + 1).cast("double").alias(f"{c}_mask") for i, c in enumerate(NUM)],
        *[F.element_at("cat", i + 1).alias(f"{c}_bucket") for i, c in enumerate(SPEC.cat_cols)],
        F.array_join("seq", ",").alias("seq"))


@register("labels_groups", ob.query(IT, f"""SELECT rid, clicked::TINYINT AS y,
       {ob.group_hash(['inventory_id', 'day_of_week'])} AS "groups" FROM train"""))
def q_labels_groups(spark, sf_dir):
    """Column-pruned (rid, y, groups) read from a written cache (2.1 #11)."""
    tr = fx.train(spark, sf_dir)
    path = sh.scratch_path(spark, "cache")
    sh.write_shards(fe.transform(tr, fe.fit(tr, SPEC)), path, SHARD_ROWS)
    return sh.load_labels_groups(path, spark)


# ---------------------------------------------------------------- projections and predicates
@register("glob_select", ob.query(I, "SELECT rid, feat_a_1, inventory_id, user_id FROM impressions"))
def q_glob_select(spark, sf_dir):
    """Anchored globs ('feat_*', '*_id'), de-duplicated and sorted (2.2 #1-2)."""
    imp = fx.impressions(spark, sf_dir)
    return imp.select("rid", *fe.match_patterns(imp.columns, ["feat_*", "*_id", "feat_a_*"]))


@register("drop_columns", ob.query(I, "SELECT * EXCLUDE (value, k, seq) FROM impressions"))
def q_drop_columns(spark, sf_dir):
    """Configured columns dropped, also from the numeric set (2.2 #3)."""
    return fx.impressions(spark, sf_dir).drop("value", "k", "seq")


@register("missing_mask", ob.query(I, f"""SELECT rid, {', '.join(f'{miss_sql(c)}::TINYINT AS {c}_mask' for c in NUM)}
FROM impressions"""))
def q_missing_mask(spark, sf_dir):
    """One 0/1 column per numeric: null or NaN (2.2 #5)."""
    imp = fx.impressions(spark, sf_dir)
    return imp.select("rid", *[fe.is_missing(F.col(c)).cast("tinyint").alias(f"{c}_mask") for c in NUM])


@register("median_stats", ob.query(IT + [med_sql("train", NUM)], "SELECT * FROM med",
                                   [f"m_{c}" for c in NUM]))
def q_median_stats(spark, sf_dir):
    """Exact global median per numeric column in one aggregation (2.4 #1)."""
    tr = fx.train(spark, sf_dir)
    meds = fe.median_values(tr, NUM)
    return spark.range(1).select(*[meds[c].alias(f"m_{c}") for c in NUM])


@register("impute_median", ob.query(IT + [med_sql("train", NUM)], f"""SELECT rid,
       {', '.join(f'{imp_sql(c, "med.m_" + c)} AS {c}' for c in NUM)} FROM impressions, med""", NUM))
def q_impute_median(spark, sf_dir):
    """Missing numerics replaced by the train median (2.2 #6)."""
    meds = fe.median_values(fx.train(spark, sf_dir), NUM)
    imp = fx.impressions(spark, sf_dir)
    return imp.select("rid", *[fe.imputed(c, meds[c]).alias(c) for c in NUM])


@register("impute_zero", ob.query(I, f"""SELECT rid, {imp_sql('feat_a_1', '0.0')} AS feat_a_1 FROM impressions""",
                                  ["feat_a_1"]))
def q_impute_zero(spark, sf_dir):
    """impute_strategy other than median: 0.0 (2.2 #6)."""
    return fx.impressions(spark, sf_dir).select("rid", fe.imputed("feat_a_1", F.lit(0.0)).alias("feat_a_1"))


X_SQL = ("CASE WHEN rid % 13 = 0 THEN 'inf'::DOUBLE WHEN rid % 13 = 1 THEN '-inf'::DOUBLE "
         "WHEN rid % 13 = 2 THEN 'nan'::DOUBLE ELSE feat_a_1 END")


def x_col():
    r = F.col("rid") % 13
    return (F.when(r == 0, F.lit(float("inf"))).when(r == 1, F.lit(float("-inf")))
            .when(r == 2, F.lit(float("nan"))).otherwise(F.col("feat_a_1")))


@register("clamp_nonfinite", ob.query(
    I + [f"xs AS (SELECT rid, {X_SQL} AS x FROM impressions)", med_sql("xs", ["x"])],
    f"SELECT rid, {clamp_sql(imp_sql('x', 'med.m_x'))} AS x, {miss_sql('x')}::TINYINT AS x_mask FROM xs, med",
    ["x"]))
def q_clamp_nonfinite(spark, sf_dir):
    """Impute, then NaN -> 0, +inf -> 1e6, -inf -> -1e6; infinities keep mask 0 (2.2 #7)."""
    xs = fx.impressions(spark, sf_dir).select("rid", x_col().alias("x"))
    med = fe.median_values(xs, ["x"])["x"]
    return xs.select("rid", fe.clamp_nonfinite(fe.imputed("x", med)).alias("x"),
                     fe.is_missing(F.col("x")).cast("tinyint").alias("x_mask"))


@register("id_normalise", ob.query(ITT, """SELECT rid, repeat(coalesce(CAST("ID" AS VARCHAR), ''), 20) AS ids FROM test
UNION ALL SELECT event_id AS rid, CAST(event_id AS VARCHAR) AS ids FROM events"""))
def q_id_normalise(spark, sf_dir):
    """ID to string, null -> '', never cut (the IDs here are over 64 characters long); a table
    without ID falls back to its row id (2.2 #8)."""
    te = fx.test(spark, sf_dir).withColumn("ID", F.repeat("ID", F.lit(20)))
    ev = tb.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("rid"))
    return te.select("rid", fe.normalised_id(te).alias("ids")).unionByName(
        ev.select("rid", fe.normalised_id(ev).alias("ids")))


# ---------------------------------------------------------------- hashing and sequences
HB = {"inventory_id": 1520, "day_of_week": 1509, "hour": 1526, "l_feat_14": 4739}


@register("hash_bucket", ob.query(I, "SELECT rid, " + ", ".join(
    f"{ob.bucket(c, m)} AS b_{c}" for c, m in HB.items()) + " FROM impressions"))
def q_hash_bucket(spark, sf_dir):
    """Category buckets: md5 of the string form (null -> 'NA') mod per-column size (2.7 #1-2)."""
    imp = fx.impressions(spark, sf_dir)
    return imp.select("rid", *[bucket(c, m, "md5").alias(f"b_{c}") for c, m in HB.items()])


@register("group_hash", ob.query(I, f"""SELECT rid, {ob.group_hash(['inventory_id', 'day_of_week'])} AS g_comp,
       {ob.group_hash(['l_feat_14'])} AS g_single FROM impressions"""))
def q_group_hash(spark, sf_dir):
    """Group id modulo 2^31-1; composite of (group, time), each null -> 'NA' (2.7 #3)."""
    imp = fx.impressions(spark, sf_dir)
    return imp.select("rid", group_hash(["inventory_id", "day_of_week"], "md5").alias("g_comp"),
                      group_hash(["l_feat_14"], "md5").alias("g_single"))


@register("seq_pad", ob.query(I, f"""SELECT rid, array_to_string({strict_pad_sql('seq', 16)}, ',') AS seq_padded,
       len(list_filter(string_split(coalesce(seq, ''), ','), lambda x: x <> ''))::INT AS n_tokens FROM impressions"""))
def q_seq_pad(spark, sf_dir):
    """Strict parse, keep the last 16, left-pad with 0 (2.7 #4)."""
    imp = fx.impressions(spark, sf_dir)
    p = parse_strict(F.col("seq"))
    return imp.select("rid", F.array_join(left_pad(p, 16, 0), ",").alias("seq_padded"),
                      F.size(p).alias("n_tokens"))


# ---------------------------------------------------------------- the block
def block_sql(src: str) -> str:
    cats = ", ".join([f"{ob.bucket(c, SPEC.buckets(c))} AS {c}_bucket" for c in SPEC.cat_cols if c != "gender"]
                     + ["0 AS gender_bucket"])
    nums = ", ".join(f"CAST({clamp_sql(imp_sql(c, 'med.m_' + c))} AS FLOAT)::DOUBLE AS {c}" for c in NUM)
    masks = ", ".join(f"{miss_sql(c)}::TINYINT AS {c}_mask" for c in NUM)
    return (f"""SELECT rid, {{y}} AS y, {ob.group_hash(['inventory_id', 'day_of_week'])} AS "groups",
       coalesce(CAST("ID" AS VARCHAR), '') AS ids, {nums}, {masks}, {cats},
       array_to_string({strict_pad_sql('seq', 16)}, ',') AS seq FROM {src}, med""")


@register("feature_block", ob.query(IT + [med_sql("train", NUM)],
                                    block_sql("train").replace("{y}", "clicked::TINYINT"), NUM))
def q_feature_block(spark, sf_dir):
    """Block arrays in config order (absent category -> 0), read back element-wise (2.2 #9)."""
    tr = fx.train(spark, sf_dir)
    b = fe.transform(tr, fe.fit(tr, SPEC), arrays=True)
    cats = [F.element_at("X_cat", i + 1).alias(f"{c}_bucket") for i, c in enumerate(SPEC.cat_cols)]
    nums = [F.element_at("X_num", i + 1).cast("double").alias(c) for i, c in enumerate(NUM)]
    masks = [F.element_at("X_mask", i + 1).alias(f"{c}_mask") for i, c in enumerate(NUM)]
    return b.select("rid", "y", "groups", "ids", *nums, *masks, *cats,
                    F.array_join("seq", ",").alias("seq"))


@register("train_test_features", ob.query(
    ITT + [med_sql("train", NUM)],
    "SELECT 'train' AS split, * FROM (" + block_sql("train").replace("{y}", "clicked::TINYINT") + ")"
    " UNION ALL SELECT 'test' AS split, * FROM (" + block_sql("test").replace("{y}", "0::TINYINT") + ")", NUM))
def q_train_test_features(spark, sf_dir):
    """Fit on train, transform train and test with the train medians (2.1 #10, D3)."""
    tr, te = fx.train(spark, sf_dir), fx.test(spark, sf_dir)
    fitted = fe.fit(tr, SPEC)

    def flat(df, is_train, split):
        b = fe.transform(df, fitted, is_train=is_train, arrays=False)
        return b.select(F.lit(split).alias("split"), *[
            F.col(c).cast("double").alias(c) if c in NUM else F.col(c) for c in b.columns]) \
            .withColumn("seq", F.array_join("seq", ","))
    return flat(tr, True, "train").unionByName(flat(te, False, "test"))
