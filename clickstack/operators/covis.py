"""Co-visitation ("covis") features: smoothed click rates per
(history token x target value x time bin), out of fold, joined back per row.

Plan shape (one scan of the training rows for every fold and target):

1. ``token_rows``: parse + tail the history, ``posexplode`` it (no window), stack the
   target columns as rows so K targets share one shuffle.
2. ``pair_stats_wide``: ONE ``groupBy(key)`` with per-fold conditional sums (map-side
   partial aggregation; a hot token collapses before the shuffle).
3. ``pair_stats_oof``: counts are additive, so fold f = total - own fold; ``max_pos``
   is the max over the other folds.  Keys whose other folds are empty are dropped.
4. ``row_features``: left join of the row's tokens to the stats (plain equality, null
   keys never match), then one ``groupBy(row)`` with 8 aggregates per target.

Where the table of pair keys is small (checked), 4. takes no token apart: rows are dealt by their key and
each task aggregates their token arrays against the whole table (``covisrows``).

Per-key tables are stored in buckets of the pair key (``stored``), so any number of row sets looks
them up without shuffling them again (``look_up``); out-of-fold lookups read the totals and the own
fold's counts of a key and subtract (``row_features_oof``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import counted_positions, empty_int_array, parse_lenient, tail, time_bin as time_bin_expr
from ..session import cut_lineage, drop_at_exit, may_broadcast, scratch_folder
from . import covisrows

# Reference defaults for the covis configuration.
DEFAULT_AGGS = ("sum_ctr", "mean_ctr", "max_ctr", "top3_mean_ctr",
                "wmean_ctr", "sum_impr", "max_impr", "pnorm_ctr")
DEFAULT_P0 = 0.019
CTR_INNER_CLIP = (1e-9, 1 - 1e-9)

KEYS = ["target", "target_value", "token", "time_bin"]


@dataclass(frozen=True)
class CovisSpec:
    targets: tuple = ("l_feat_14",)
    time_bin: str | None = "day_of_week"  # 'day_of_week' | 'hour' | 'day_of_week_hour' | None
    seq_col: str = "seq"
    label_col: str = "clicked"
    row_key: str = "rid"
    seq_top_k: int = 120
    recency_tau: float = 512.0
    recency: str = "from_start"  # pos 0 = oldest kept token (as coded) | 'from_end'
    min_impr: int = 10
    prior_strength: float = 50.0
    ctr_clip: tuple = (1e-3, 0.999)
    agg_topn: int = 3
    agg_outputs: tuple = DEFAULT_AGGS
    n_folds: int = 5
    fold_group: tuple = ("inventory_id", "day_of_week")
    allow_empty_oof: bool = False
    extra: dict = field(default_factory=dict)

    def agg_name(self, agg: str) -> str:
        return f"top{self.agg_topn}_mean_ctr" if agg == "top3_mean_ctr" else agg

    def feature_columns(self) -> list[str]:
        return [f"{t}_{self.agg_name(a)}" for t in self.targets for a in self.agg_outputs]

    def validate(self) -> None:
        """Refuse settings where every out-of-fold lookup must miss: when the fold
        group columns all sit inside the pair key, no other fold can hold the key."""
        key_cols = set()
        if self.time_bin == "day_of_week_hour":
            key_cols |= {"day_of_week", "hour"}
        elif self.time_bin:
            key_cols.add(self.time_bin)
        for t in self.targets:
            if set(self.fold_group) <= (key_cols | {t}) and not self.allow_empty_oof:
                raise ValueError(
                    f"fold groups {self.fold_group} lie inside the pair key of target {t!r}: "
                    "all out-of-fold features would be empty (pass allow_empty_oof=True)")


def token_rows(df: DataFrame, spec: CovisSpec, keep: list[str] | None = None,
               outer: bool = False) -> DataFrame:
    """One row per (row, kept history position, target).

    Columns: ``keep`` + target, target_value (string), time_bin, pos, token, w_rec.
    ``outer=False`` drops empty histories and junk (null) tokens (pair statistics);
    ``outer=True`` keeps rows without tokens as one null token (row features)."""
    keep = list(keep or [])
    tb = time_bin_expr(spec.time_bin)
    tb = F.lit(0) if tb is None else tb
    toks = F.coalesce(kept_tokens(df, spec), empty_int_array())
    stacked = F.array(*[F.struct(F.lit(t).alias("target"),
                                 F.col(t).cast("string").alias("target_value"))
                        for t in spec.targets])
    # per-row values (length, stacked targets) are projected before the generator so
    # they are computed once per row, not once per exploded token
    base = df.select(*keep, tb.alias("time_bin"), toks.alias("_toks"), stacked.alias("_tg"))
    base = base.withColumn("_valid", F.array_compact("_toks"))
    base = base.withColumn("_len", F.size("_valid"))
    if outer:
        # only rows with junk carry their positions along, the others take the generator's
        base = base.withColumn("_at", F.when(F.col("_len") < F.size("_toks"), counted_positions("_toks")["pos"]))
        exploded = base.select(*keep, "time_bin", "_tg", "_len", "_at", F.posexplode_outer("_toks").alias("_p", "token"))
        exploded = exploded.withColumn("pos", F.when(F.col("_at").isNull(), F.col("_p")).otherwise(F.get("_at", F.col("_p"))))
    else:
        exploded = base.select(*keep, "time_bin", "_tg", "_len", F.posexplode("_valid").alias("pos", "token"))
    if spec.recency == "from_end":
        age = F.col("_len") - 1 - F.col("pos")
    else:
        age = F.col("pos")
    w = F.exp(-age.cast("double") / F.lit(float(spec.recency_tau)))
    return exploded.select(*keep, F.inline("_tg"), "time_bin", "pos", "token", w.alias("w_rec"))


def smoothed_ctr(clicks: Column, impr: Column, p0: Column, spec: CovisSpec) -> Column:
    """Beta-smoothed rate (clicks + p0*S) / (impr + S), then clipped to ``ctr_clip``."""
    s = F.lit(float(spec.prior_strength))
    raw = (clicks.cast("double") + p0 * s) / (impr.cast("double") + s)
    inner = F.least(F.greatest(raw, F.lit(CTR_INNER_CLIP[0])), F.lit(CTR_INNER_CLIP[1]))
    return F.least(F.greatest(inner, F.lit(float(spec.ctr_clip[0]))), F.lit(float(spec.ctr_clip[1])))


def _finish(stats: DataFrame, p0: Column, spec: CovisSpec) -> DataFrame:
    return stats.withColumn("ctr", smoothed_ctr(F.col("clicks"), F.col("impr"), p0, spec)) \
                .withColumn("is_lowcount", F.col("impr") < F.lit(spec.min_impr))


def stored(stats: DataFrame) -> DataFrame:
    """``stats`` (one row per pair key) written to the shared folder in buckets of the pair key, as many
    as there are shuffle partitions.  The aggregation has dealt its rows in the same way, so each
    bucket is one file, and a join on the pair key does not shuffle the table again."""
    spark = stats.sparkSession
    name = f"pairs_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drop_at_exit(spark, name)
    (stats.write.format("parquet").option("path", scratch_folder(spark, "pairs")).bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(name))
    return spark.table(name)


HEAVY = 1000  # keys with a 1000th of all training pairs or more, so 1000 at most, are looked up by broadcast


def look_up(tokens: DataFrame, stats: DataFrame, cols: list[str], size: str = "impr") -> DataFrame:
    """``tokens`` with ``cols`` of their pair key, null where there is none.  Tokens of the heaviest keys take
    them from a broadcast and are then spread over the partitions under a key that matches nothing,
    so no partition holds all tokens of such a key."""
    total = stats.agg(F.sum(size)).first()[0] or 0
    heavy = stats.where(F.col(size) * HEAVY >= F.lit(total)).select(*KEYS, F.struct(*cols).alias("_heavy"))
    t = tokens.join(F.broadcast(heavy), KEYS, "left")
    held = F.col("_heavy").isNotNull()
    spread = F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(HEAVY)).cast("string"))
    t = t.select("*", F.when(~held, F.col("token")).alias("_token"), F.when(held, spread).otherwise(F.col("target_value")).alias("_value"))
    on = [t["target"] == F.col("_t0"), t["_value"] == F.col("_t1"), t["_token"] == F.col("_t2"), t["time_bin"] == F.col("_t3")]
    side = stats.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(KEYS)], F.struct(*cols).alias("_found"))
    both = t.join(side, on, "left").withColumn("_of", F.coalesce("_heavy", "_found"))
    return both.select(*tokens.columns, *[F.col(f"_of.{c}").alias(c) for c in cols])


def pair_stats_full(tokens: DataFrame, spec: CovisSpec, materialize: bool = True) -> DataFrame:
    """Pair statistics over all training rows (used for the test set).

    The per-key table is written once to the shared folder: the prior (a scalar over
    it) and the statistics then read the same files instead of aggregating twice
    (column pruning gives the prior's aggregation a different plan, so Spark would not
    reuse the exchange)."""
    g = tokens.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("impr"),
        F.sum(F.col(spec.label_col).cast("long")).alias("clicks"),
        F.sum("w_rec").alias("w_rec_sum"),
        F.max("pos").alias("max_pos"))
    if materialize:
        g = stored(g)
    # prior = mean click over exploded rows; the stats table holds the same sums
    p0 = g.agg(F.coalesce(F.sum("clicks") / F.sum("impr"), F.lit(DEFAULT_P0))).scalar()
    return _finish(g, p0, spec)


def pair_stats_wide(tokens: DataFrame, spec: CovisSpec, fold_col: str = "fold") -> DataFrame:
    """One row per pair key with totals and per-fold counts in columns."""
    n = spec.n_folds
    f = F.col(fold_col)
    y = F.col(spec.label_col).cast("long")
    aggs = [F.count(F.lit(1)).alias("impr_all"), F.sum(y).alias("clicks_all"),
            F.sum("w_rec").alias("w_all")]
    for i in range(n):
        hit = f == i
        aggs += [F.count(F.when(hit, F.lit(1))).alias(f"impr_{i}"),
                 F.sum(F.when(hit, y)).alias(f"clicks_{i}"),
                 F.sum(F.when(hit, F.col("w_rec"))).alias(f"w_{i}"),
                 F.max(F.when(hit, F.col("pos"))).alias(f"maxpos_{i}")]
    return tokens.groupBy(*KEYS).agg(*aggs)


def pair_stats_of_rows(rows: DataFrame, spec: CovisSpec) -> DataFrame:
    """``pair_stats_wide`` of rows with ``fold``, counted per task over the token arrays (``covisrows``) before the
    shuffle: no row per token."""
    counts = covisrows.pair_counts(_row_tokens(rows, spec, ["fold", spec.label_col]).where(F.size("_toks") > 0), spec)
    aggs = [F.sum("n").alias("impr_all"), F.sum("clicks").alias("clicks_all"), F.sum("w").alias("w_all")]
    for i in range(spec.n_folds):
        own = lambda c: F.when(F.col("fold") == i, F.col(c))
        aggs += [F.coalesce(F.sum(own("n")), F.lit(0)).alias(f"impr_{i}"), F.sum(own("clicks")).alias(f"clicks_{i}"),
                 F.sum(own("w")).alias(f"w_{i}"), F.max(own("pos")).alias(f"maxpos_{i}")]
    return counts.groupBy(*KEYS).agg(*aggs)


def oof_priors(wide: DataFrame, spec: CovisSpec) -> Column:
    """Array (index = fold) of the prior over the rows outside each fold, as one
    scalar subquery over the per-key table."""
    tot_i, tot_c = F.sum("impr_all"), F.sum("clicks_all")
    vals = []
    for i in range(spec.n_folds):
        den = tot_i - F.sum(f"impr_{i}")
        num = tot_c - F.coalesce(F.sum(f"clicks_{i}"), F.lit(0))
        vals.append(F.when(den > 0, num / den).otherwise(F.lit(DEFAULT_P0)))
    return wide.agg(F.array(*vals)).scalar()


def pair_stats_full_from_wide(wide: DataFrame, spec: CovisSpec) -> DataFrame:
    """Full-train statistics are the totals of the per-fold table: no second pass."""
    n = spec.n_folds
    maxpos = F.greatest(*[F.col(f"maxpos_{i}") for i in range(n)]) if n > 1 else F.col("maxpos_0")
    g = wide.select(*KEYS, F.col("impr_all").alias("impr"), F.col("clicks_all").alias("clicks"),
                    F.col("w_all").alias("w_rec_sum"), maxpos.alias("max_pos"))
    p0 = wide.agg(F.coalesce(F.sum("clicks_all") / F.sum("impr_all"), F.lit(DEFAULT_P0))).scalar()
    return _finish(g, p0, spec)


def pair_stats_oof(tokens: DataFrame, spec: CovisSpec, fold_col: str = "fold",
                   materialize: bool = True) -> DataFrame:
    """Pair statistics of every fold f computed from the other folds, by subtraction.
    The per-key table is aggregated once and (by default) written to the shared folder,
    so the fold priors and the statistics read it instead of aggregating twice."""
    wide = pair_stats_wide(tokens, spec, fold_col)
    return pair_stats_oof_from_wide(stored(wide) if materialize else wide, spec)


def pair_stats_oof_from_wide(wide: DataFrame, spec: CovisSpec) -> DataFrame:
    spec.validate()
    n = spec.n_folds
    p0s = oof_priors(wide, spec)
    per_fold = []
    for i in range(n):
        others = [F.col(f"maxpos_{j}") for j in range(n) if j != i]
        maxpos = others[0] if len(others) == 1 else F.greatest(*others)
        per_fold.append(F.struct(
            F.lit(i).alias("fold"),
            (F.col("impr_all") - F.col(f"impr_{i}")).alias("impr"),
            (F.col("clicks_all") - F.coalesce(F.col(f"clicks_{i}"), F.lit(0))).alias("clicks"),
            (F.col("w_all") - F.coalesce(F.col(f"w_{i}"), F.lit(0.0))).alias("w_rec_sum"),
            maxpos.alias("max_pos")))
    long = wide.select(*KEYS, F.inline(F.array(*per_fold))).where(F.col("impr") > 0)
    p0 = F.element_at(p0s, F.col("fold") + 1)
    return _finish(long, p0, spec)


def _row_aggregates(spec: CovisSpec) -> list[Column]:
    aggs = []
    for t in spec.targets:
        hit = F.col("target") == t
        ctr = F.when(hit, F.col("ctr"))
        w = F.when(hit, F.col("w_rec"))
        impr = F.when(hit, F.coalesce(F.col("impr"), F.lit(0)).cast("double"))
        top = F.slice(F.sort_array(F.collect_list(ctr), False), 1, spec.agg_topn)
        exprs = {
            "sum_ctr": F.sum(ctr),
            "mean_ctr": F.avg(ctr),
            "max_ctr": F.max(ctr),
            "top3_mean_ctr": F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), F.size(top)),
            "wmean_ctr": F.try_divide(F.coalesce(F.sum(ctr * w), F.lit(0.0)), F.sum(w)),
            "sum_impr": F.sum(impr),
            "max_impr": F.max(impr),
            "pnorm_ctr": F.sqrt(F.avg(ctr * ctr)),
        }
        for a in spec.agg_outputs:
            aggs.append(F.coalesce(exprs[a].cast("double"), F.lit(0.0))
                        .alias(f"{t}_{spec.agg_name(a)}"))
    return aggs


SHARED_KEYS = 500_000  # pair keys, times folds, that every task may hold


def few_keys(stats: DataFrame, times: int = 1) -> bool:
    """Whether the table of pair keys is small enough (checked) for every task to hold it."""
    return may_broadcast(stats.sparkSession) and stats.limit(SHARED_KEYS // times + 1).count() * times <= SHARED_KEYS


def _row_tokens(rows: DataFrame, spec: CovisSpec, keep: list[str]) -> DataFrame:
    """(keep..., ``_bin``, ``_v0`` .. values of the targets, ``_toks`` kept tokens) of every row."""
    tb = time_bin_expr(spec.time_bin)
    return rows.select(*keep, (F.lit(0) if tb is None else tb).cast("int").alias("_bin"),
                       *[F.col(t).cast("string").alias(f"_v{i}") for i, t in enumerate(spec.targets)],
                       kept_tokens(rows, spec).alias("_toks"))


def kept_tokens(rows: DataFrame, spec: CovisSpec) -> Column:
    """The tail of the history, which is a text or already an array of tokens; of a text only the kept pieces
    are parsed."""
    seq = F.col(spec.seq_col)
    if dict(rows.dtypes)[spec.seq_col] == "array<int>":
        return tail(seq, spec.seq_top_k)
    return parse_lenient(F.substring_index(seq, ",", -spec.seq_top_k))


def parsed(rows: DataFrame, spec: CovisSpec) -> DataFrame:
    """``rows`` with their histories parsed and cut, written once for all passes over them (parsed ones are left)."""
    if dict(rows.dtypes)[spec.seq_col] == "array<int>":
        return rows
    return cut_lineage(rows.withColumn(spec.seq_col, kept_tokens(rows, spec)), "rows")


def row_features(rows: DataFrame, stats: DataFrame, spec: CovisSpec, row_cols: list[str],
                 join_fold: bool = False) -> DataFrame:
    """Per row x target aggregates of the matched pair statistics, null -> 0.

    ``rows`` carries the sequence, targets and time columns; ``row_cols`` are kept as
    the output key (e.g. rid, fold or ID).  With ``join_fold`` the lookup key includes
    the row's fold, so each row sees only statistics built without its own fold."""
    keep = list(row_cols) + (["fold"] if join_fold and "fold" not in row_cols else [])
    on = KEYS + (["fold"] if join_fold else [])
    if not join_fold and few_keys(stats):
        return covisrows.aggregates(_row_tokens(rows, spec, keep), stats.select(*on, "impr", "ctr"), spec, row_cols)
    rt = token_rows(rows, spec, keep=keep, outer=True)
    if join_fold:
        joined = rt.join(stats.select(*on, "impr", "ctr"), on, "left")
    else:
        joined = look_up(rt, stats, ["impr", "ctr"])
    return joined.groupBy(*row_cols).agg(*_row_aggregates(spec))


def row_features_oof(rows: DataFrame, wide: DataFrame, spec: CovisSpec, row_cols: list[str]) -> DataFrame:
    """``row_features`` of rows with ``fold``, each from the pair statistics without its own fold.

    ``wide`` (``pair_stats_wide``, stored) has one row per key; a token reads the totals and its own fold's
    counts and subtracts, so no table with a row per key and fold is made or shuffled."""
    spec.validate()
    keep = list(row_cols) + (["fold"] if "fold" not in row_cols else [])
    if few_keys(wide, spec.n_folds):
        stats = pair_stats_oof_from_wide(wide, spec).select(*KEYS, "fold", "impr", "ctr")
        return covisrows.aggregates(_row_tokens(rows, spec, keep), stats, spec, row_cols)
    own = lambda c: F.array(*[F.coalesce(F.col(f"{c}_{i}"), F.lit(0)) for i in range(spec.n_folds)]).alias(c)
    lookup = wide.select(*KEYS, "impr_all", "clicks_all", own("impr"), own("clicks"))
    found = look_up(token_rows(rows, spec, keep=keep, outer=True), lookup, ["impr_all", "clicks_all", "impr", "clicks"], "impr_all")
    of = (F.col("fold") + 1).cast("int")
    impr = F.col("impr_all") - F.element_at("impr", of)
    counted = found.withColumn("_n", F.when(impr > 0, impr)).withColumn("_c", F.col("clicks_all") - F.element_at("clicks", of))
    ctr = smoothed_ctr(F.col("_c"), F.col("_n"), F.element_at(oof_priors(wide, spec), of), spec)
    known = F.col("_n").isNotNull()
    joined = counted.withColumn("ctr", F.when(known, ctr)).withColumn("impr", F.col("_n"))
    return joined.groupBy(*row_cols).agg(*_row_aggregates(spec))


def build_oof_and_test(train: DataFrame, test: DataFrame, spec: CovisSpec,
                       test_key: str = "ID") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``train`` must carry ``fold``.  Returns (pair_oof, pair_full, rowfeat_oof, rowfeat_test).

    The per-fold pair table is aggregated ONCE and written to the shared folder; both
    the out-of-fold and the full-train statistics are derived from it."""
    train = parsed(train, spec)
    wide = stored(pair_stats_of_rows(train, spec))
    oof = pair_stats_oof_from_wide(wide, spec)
    full = pair_stats_full_from_wide(wide, spec)
    rf_oof = row_features_oof(train, wide, spec, [spec.row_key, "fold"])
    rf_test = row_features(test, full, spec, [test_key])
    return oof, full, rf_oof, rf_test


def join_features(df: DataFrame, feats: DataFrame, key: str, feature_cols: list[str]) -> DataFrame:
    """Left join row features on ``key``; rows without features get 0.0."""
    out = df.join(feats.select(key, *feature_cols), key, "left")
    return out.fillna(0.0, subset=feature_cols)


def write_outputs(pair_oof: DataFrame, pair_full: DataFrame, rf_oof: DataFrame, rf_test: DataFrame,
                  out_dir: str, mode: str = "overwrite") -> None:
    """Parquet sinks: one dataset per output, partitioned by target / fold instead of one
    file per fold and target."""
    pair_oof.write.mode(mode).partitionBy("target", "fold").parquet(f"{out_dir}/pair_oof")
    pair_full.write.mode(mode).partitionBy("target").parquet(f"{out_dir}/pair_full")
    rf_oof.write.mode(mode).partitionBy("fold").parquet(f"{out_dir}/rowfeat_oof")
    rf_test.write.mode(mode).parquet(f"{out_dir}/rowfeat_test")
