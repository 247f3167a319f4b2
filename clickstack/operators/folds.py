"""Fold assignment: group folds, stratified group folds, hold-out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import ship
from ..functions.hashing import SEP, group_hash, md5_u32
from ..session import cut_lineage
from .rowindex import global_ordinal, ordinal_by_buckets, places


def with_group(df: DataFrame, group_cols: list[str], mode: str = "xxhash",
               out: str = "g") -> DataFrame:
    """Add the group id (hash of the group columns, each null -> 'NA').  Missing group
    columns give group 0, as a table without the group key has one group."""
    present = [c for c in group_cols if c in df.columns]
    g = group_hash(present, mode) if present else F.lit(0).cast("long")
    return df.withColumn(out, g)


def group_fold_map(df: DataFrame, n_folds: int = 5, g_col: str = "g") -> DataFrame:
    """(g, fold): distinct group ids sorted ascending, numbered, ``ordinal % n_folds``.

    Group ids are hashes in [0, 2**31-1), so their top bits make evenly filled,
    order-preserving buckets for the distributed numbering."""
    groups = df.select(g_col).distinct().withColumn("_gb", F.shiftright(F.col(g_col), 24))
    numbered = ordinal_by_buckets(groups, [g_col], "_gb", "_ord")
    return numbered.select(g_col, (F.col("_ord") % n_folds).cast("int").alias("fold"))


def group_folds(df: DataFrame, group_cols: list[str], n_folds: int = 5, mode: str = "xxhash",
                rid_col: str = "rid") -> DataFrame:
    """(rid, fold) for every row; a group never straddles two folds."""
    gdf = with_group(df.select(rid_col, *[c for c in group_cols if c in df.columns]), group_cols, mode)
    fmap = group_fold_map(gdf, n_folds)
    return gdf.join(fmap, "g", "left").select(rid_col, "fold")


def attach_folds(df: DataFrame, group_cols: list[str], n_folds: int = 5,
                 mode: str = "xxhash") -> DataFrame:
    """Add ``fold`` to every row through its group: the join is against the (small)
    group -> fold map, never against a per-row fold table."""
    gdf = with_group(df, group_cols, mode)
    # groups are hashed once per value of their columns, not once per row
    present = [c for c in group_cols if c in df.columns]
    groups = with_group(df.select(*present).distinct(), group_cols, mode) if present else gdf
    # the map is written first: a join that knows its size does not shuffle the rows, histories and all, by their group
    return gdf.join(cut_lineage(group_fold_map(groups, n_folds), "foldmap"), "g", "left")


PROFILES = 10_000  # profiles that are dealt together


def deal_profiles(profiles: list[tuple[int, int, int]], total: tuple[int, int], n_folds: int) -> list[list[int]]:
    """Folds of the leftover groups of each profile.  ``profiles`` are (positives, negatives, leftover
    groups), most uneven first; every group goes where the classes' shares over the folds vary least,
    to the fold with fewer rows and then the lower number on a tie."""
    held = np.zeros((n_folds, 2))
    total = np.maximum(np.array(total, float), 1.0)
    out = []
    for pos, neg, m in profiles:
        mine = []
        for _ in range(m):
            share = np.repeat((held / total)[None], n_folds, 0)
            share[np.arange(n_folds), np.arange(n_folds)] += np.array([pos, neg]) / total
            spread = np.round(share.std(axis=1).mean(axis=1), 12)
            rows = held.sum(axis=1)
            f = min(range(n_folds), key=lambda i: (spread[i], rows[i], i))
            held[f] += (pos, neg)
            mine.append(f)
        out.append(mine)
    return out


def stratified_group_fold_map(df: DataFrame, label_col: str, n_splits: int = 5,
                              seed: int = 777, g_col: str = "g", block: int = PROFILES) -> DataFrame:
    """(g, fold): groups are never split and the folds' positive rates are balanced greedily.

    Groups with the same positives and size are interchangeable.  Of m such groups, taken in the
    order of a seeded hash, the first ``m - m % n`` go round the folds; the leftover ones, at most
    n - 1 of a profile, are dealt greedily, profiles with the largest difference between the classes
    first.  A task deals ``block`` profiles, balancing them by themselves."""
    n = int(n_splits)
    if n < 2:
        raise ValueError("stratified folds need at least two; see holdout for one validation part")
    one = (F.col(label_col) == 1).cast("long")
    groups = cut_lineage(df.groupBy(g_col).agg(F.sum(F.coalesce(one, F.lit(0))).alias("_pos"), F.count(F.lit(1)).alias("_n")), "groups")
    tie = md5_u32(F.concat_ws(SEP, F.lit(str(seed)), F.col(g_col).cast("string")))
    ranked = places(groups.withColumn("_tie", tie), ["_pos", "_n"], [F.col("_tie"), F.col(g_col)], "_i")
    profiles = groups.groupBy("_pos", "_n").agg(F.count(F.lit(1)).alias("_m"))
    neg = F.col("_n") - F.col("_pos")
    order = [F.desc(F.abs(F.col("_pos") - neg)), F.desc("_n"), F.desc("_pos")]
    numbered = global_ordinal(profiles, order, "_at").withColumn("_block", F.floor(F.col("_at") / block))
    total = groups.agg(F.sum("_pos"), F.sum(neg)).first()
    total = (total[0] or 0, total[1] or 0)

    def deal(rows):
        rows = rows.sort_values("_at")
        dealt = deal_profiles(list(zip(rows["_pos"], rows["_n"] - rows["_pos"], rows["_m"] % n)), total, n)
        return rows[["_pos", "_n", "_m"]].assign(_left=dealt)

    ship(df.sparkSession)
    dealt = cut_lineage(numbered.groupBy("_block").applyInPandas(deal, "_pos long, _n long, _m long, _left array<int>"), "dealt")
    whole = F.col("_m") - F.col("_m") % n
    fold = F.when(F.col("_i") < whole, F.col("_i") % n).otherwise(F.get("_left", (F.col("_i") - whole).cast("int")))
    mapped = ranked.join(dealt, ["_pos", "_n"]).select(g_col, fold.cast("int").alias("fold"))
    return cut_lineage(mapped, "folds")


def holdout(folds: DataFrame, fold_col: str = "fold") -> DataFrame:
    """``n_splits == 1``: only fold 0 of 5 is used as validation."""
    return folds.withColumn("is_valid", (F.col(fold_col) == 0).cast("int"))
