"""Co-visitation counts and row aggregates over token arrays, with no row per token.

``pair_counts``: a task counts the pairs of its rows in blocks of tokens; what it has counted is added up by
pair key.

``aggregates``, against a small table that every task holds: rows are dealt and sorted by their key; a task looks up the tokens of whole batches in the sorted pair
keys and aggregates them as padded matrices.  Rows of one key follow each other and are merged as
partial sums, of which the last key's are carried to the next batch, so nothing grows with a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_map
from ..session import cut_lineage

SUMS = 6  # per target: ctr, hits, ctr * w, w, impressions, ctr ** 2
CELLS = 1 << 20  # cells of a padded matrix, tokens that are counted together
DENSE = 1 << 22  # numbers that a table of all (group, token) may have


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct whole numbers in order and the place of each value among them."""
    if not len(values):
        return values, values
    low, high = int(values.min()), int(values.max())
    if high - low >= DENSE:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(high - low + 1, bool)
    seen[values - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[values - low]


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each value, the values by code); null is a value."""
    held = column.dictionary_encode(null_encoding="encode")
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary


class PairTable:
    """(target value, time bin, fold) -> group, (group, token) -> impressions and rate, as sorted arrays."""

    def __init__(self, values, bins, folds, tokens, impr, ctr):
        keys = list(zip(values, bins, folds))
        self.groups = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        group = np.array([self.groups[k] for k in keys], np.int64)
        token = np.array(tokens, np.int64)
        self.tokens, place = np.unique(token, return_inverse=True)
        code = group * len(self.tokens) + place
        order = np.argsort(code, kind="stable")
        self.code, self.impr, self.ctr = code[order], np.array(impr, float)[order], np.array(ctr, float)[order]
        self.at = None

    def group_of(self, values: pa.Array, bins: pa.Array, folds: pa.Array) -> np.ndarray:
        """The group of each row, -1 where the table has none; every combination is looked up once."""
        columns = [_codes(c) for c in (values, bins, folds)]
        sizes = [max(len(d), 1) for _, d in columns]
        held, at = np.unique(np.ravel_multi_index([c for c, _ in columns], sizes), return_inverse=True)
        named = zip(*[d.take(pa.array(i)).to_pylist() for i, (_, d) in zip(np.unravel_index(held, sizes), columns)])
        return np.array([self.groups.get(k, -1) for k in named], np.int64)[at]

    def _tables(self) -> None:
        """Places of the tokens and of (group, token) as plain tables where these are small; the task makes them once."""
        low, n = int(self.tokens[0]), len(self.tokens)
        self.at = ()
        if int(self.tokens[-1]) - low < DENSE and len(self.groups) * (n + 1) <= DENSE:
            place = np.full(int(self.tokens[-1]) - low + 2, n, np.int64)  # n: no token of the table
            place[self.tokens - low] = np.arange(n)
            cells = np.full((len(self.groups) + 1, n + 1), len(self.code), np.int64)  # the last group: none
            cells[self.code // n, self.code % n] = np.arange(len(self.code))
            self.at = low, place, cells.ravel(), np.append(self.impr, 0.0), np.append(self.ctr, -np.inf)

    def find(self, group: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(impressions, rate) of the pairs, 0 and -inf where there are none."""
        impr, ctr = np.zeros(len(token)), np.full(len(token), -np.inf)
        if len(self.code):
            if self.at is None:
                self._tables()
            n = len(self.tokens)
            if self.at:
                low, places, cells, impr, ctr = self.at
                inside = (token >= low) & (token < low + len(places) - 1)
                place = places[np.where(inside, token - low, len(places) - 1)]
                at = cells[np.where(group < 0, len(self.groups), group) * (n + 1) + place]
                return impr[at], ctr[at]
            place = np.minimum(np.searchsorted(self.tokens, token), n - 1)
            code = group * n + place
            at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            hit = (group >= 0) & (self.tokens[place] == token) & (self.code[at] == code)
            impr[hit], ctr[hit] = self.impr[at[hit]], self.ctr[at[hit]]
        return impr, ctr


def _tokens(toks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each row, all tokens, which are no junk)."""
    size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = toks.flatten()
    return size, pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64), flat.is_valid().to_numpy(zero_copy_only=False)


def _counted(rows: pa.Table, spec, names: list[str]):
    """Counts of the pairs (target, value, token, time bin, fold) of the rows: (fold, label, bin, values.., tokens)."""
    fold, label, bins, *values, toks = [c.combine_chunks() for c in rows.columns]
    size, token, known = _tokens(toks)
    row = np.repeat(np.arange(len(size)), size)[known]
    token, valid = token[known], np.bincount(row, minlength=len(size))
    if not len(token):
        return
    pos = np.arange(len(token)) - (np.cumsum(valid) - valid)[row]
    ages = np.exp(-np.arange(int(valid.max())) / float(spec.recency_tau))
    w = ages[valid[row] - 1 - pos if spec.recency == "from_end" else pos]
    y = pc.fill_null(label, 0).to_numpy(zero_copy_only=False).astype(float)[row]
    marked = label.is_valid().to_numpy(zero_copy_only=False)[row]
    tokens, place = _numbered(token)
    shared = [_codes(bins), _codes(fold)]
    for target, column in zip(spec.targets, values):
        columns = [_codes(column), *shared]
        sizes = [len(d) for _, d in columns]
        groups, group = np.unique(np.ravel_multi_index([c for c, _ in columns], sizes), return_inverse=True)
        code = group[row] * len(tokens) + place
        if len(groups) * len(tokens) <= DENSE:
            held = np.arange(len(groups) * len(tokens))
        else:
            held, code = np.unique(code, return_inverse=True)
        n = np.bincount(code, minlength=len(held))
        last = np.full(len(held), -1)
        np.maximum.at(last, code, pos)
        sums = [np.bincount(code, x, minlength=len(held)) for x in (y, marked, w)]
        some = np.flatnonzero(n)
        of, at = np.divmod(held[some], len(tokens))
        value, time, own = [d.take(pa.array(i)) for i, (_, d) in zip(np.unravel_index(groups[of], sizes), columns)]
        clicks, marks, weight = [x[some] for x in sums]
        yield pa.RecordBatch.from_arrays([
            pa.array([target]).take(pa.array(np.zeros(len(some), np.int64))), value, pa.array(tokens[at], pa.int32()), time, own, pa.array(n[some]),
            pa.array(clicks.astype(np.int64), mask=marks == 0), pa.array(weight), pa.array(last[some], pa.int32())], names=names)


def pair_counts(rows: DataFrame, spec) -> DataFrame:
    """(target, target_value, token, time_bin, fold, n, clicks, w, pos): what tasks have counted of each pair, so a
    pair comes once per block of tokens.  ``rows``: fold, label, ``_bin``, ``_v0`` .. and ``_toks``."""
    names = ["target", "target_value", "token", "time_bin", "fold", "n", "clicks", "w", "pos"]
    step = max(CELLS // max(spec.seq_top_k, 1), 1)

    def run(batches):
        held, cells = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                held.append(b)
                cells += len(b.columns[-1].flatten())
                if cells >= CELLS:
                    yield from _counted(pa.Table.from_batches(held), spec, names)
                    held, cells = [], 0
        if held:
            yield from _counted(pa.Table.from_batches(held), spec, names)

    return arrow_map(rows, run, f"target string, target_value string, token int, time_bin int, fold {dict(rows.dtypes)['fold']}, n long, clicks long, w double, pos int")


def _partials(toks: pa.Array, groups: list, tables: list, spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums [rows, targets * SUMS], largest impressions [rows, targets], largest rates [rows, targets, n])."""
    size, token, known = _tokens(toks)
    n, width, top = len(size), max(int(size.max(initial=0)), 1), spec.agg_topn
    cell = np.arange(width) < size[:, None]
    valid = np.zeros((n, width), bool)
    valid[cell] = known
    place = np.cumsum(valid, 1) - 1  # a junk token keeps the place of the token before it
    age = place[:, -1:] - place if spec.recency == "from_end" else place
    w = np.where(cell, np.exp(-np.arange(-1, width + 1) / float(spec.recency_tau))[age + 1], 0.0)
    row = np.repeat(np.arange(n), size)
    sums, most, best = np.zeros((n, len(tables) * SUMS)), np.zeros((n, len(tables))), np.full((n, len(tables), top), -np.inf)
    for i, (group, table) in enumerate(zip(groups, tables)):
        impr, ctr = table.find(group[row], token)
        ctr[~known], impr[~known] = -np.inf, 0.0
        rates, seen = np.full((n, width), -np.inf), np.zeros((n, width))
        rates[cell], seen[cell] = ctr, impr
        hit = rates > -np.inf
        found = np.where(hit, rates, 0.0)
        sums[:, i * SUMS:(i + 1) * SUMS] = np.stack([found.sum(1), hit.sum(1), (found * w).sum(1), w.sum(1), seen.sum(1), (found * found).sum(1)], 1)
        most[:, i] = seen.max(1)
        k = min(top, width)
        if k:
            best[:, i, :k] = np.partition(rates, width - k, axis=1)[:, width - k:]
    return sums, most, best


def _merge(first: np.ndarray, parts: tuple) -> tuple:
    """Partials of rows added up to groups that begin at ``first``."""
    sums, most, best = parts
    rows = len(sums)
    if len(first) == rows:
        return parts
    size = np.diff(np.append(first, rows))
    out = best[first]
    top = best.shape[2]
    for g in np.flatnonzero(size > 1) if top else []:
        block = best[first[g]:first[g] + size[g]].transpose(1, 0, 2).reshape(best.shape[1], -1)
        out[g] = np.partition(block, block.shape[1] - top, axis=1)[:, block.shape[1] - top:]
    return np.add.reduceat(sums, first), np.maximum.reduceat(most, first), out


def _features(parts: tuple, spec) -> list[np.ndarray]:
    sums, most, best = parts
    out = []
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b != 0)
    for i in range(most.shape[1]):
        ctr, hits, ctr_w, w, impr, square = sums[:, i * SUMS:(i + 1) * SUMS].T
        rates = best[:, i]
        held = rates > -np.inf
        of = {"sum_ctr": ctr, "mean_ctr": ratio(ctr, hits), "max_ctr": np.where(hits > 0, rates.max(1, initial=-np.inf), 0.0),
              "top3_mean_ctr": ratio(np.where(held, rates, 0.0).sum(1), held.sum(1).astype(float)), "wmean_ctr": ratio(ctr_w, w),
              "sum_impr": impr, "max_impr": most[:, i], "pnorm_ctr": np.sqrt(ratio(square, hits))}
        out += [np.ascontiguousarray(of[a]) for a in spec.agg_outputs]
    return out


def _starts(keys: list[pa.Array], rows: int) -> np.ndarray:
    """Where a key differs from the one before it (nulls are one key)."""
    same = np.ones(max(rows - 1, 0), bool)
    for c in keys:
        a, b = c.slice(0, rows - 1), c.slice(1)
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same &= equal.to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(~same) + 1)


def aggregates(rows: DataFrame, stats: DataFrame, spec, row_cols: list[str]) -> DataFrame:
    """``row_cols`` and the aggregates of each key.  ``rows`` has ``_bin``, ``_v0`` .. and ``_toks`` beside
    ``row_cols``, and ``fold`` if ``stats`` (KEYS, impr, ctr; small) has it."""
    spark = rows.sparkSession
    by_fold = "fold" in stats.columns
    held = stats.toArrow()
    tables = []
    for t in spec.targets:
        mine = held.filter(pc.equal(held["target"], t))
        cols = [mine[c].to_pylist() for c in ("target_value", "time_bin", *(["fold"] if by_fold else []), "token", "impr", "ctr")]
        keyed = [r for r in zip(*cols) if None not in r[:-2]]
        cols = list(map(list, zip(*keyed))) or [[] for _ in cols]
        tables.append(PairTable(cols[0], cols[1], cols[2] if by_fold else [0] * len(cols[0]), *cols[-3:]))
    shared = spark.sparkContext.broadcast(tables)
    n = len(row_cols)
    names = [*row_cols, *spec.feature_columns()]
    wide = len(row_cols) + (1 if by_fold and "fold" not in row_cols else 0)
    fold_at = ([*row_cols, "fold"].index("fold")) if by_fold else None
    step = max(CELLS // max(spec.seq_top_k, 1), 1)

    def run(batches):
        tail_keys, tail_parts = None, None
        types = None
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                keys = [b.column(i) for i in range(n)]
                types = [k.type for k in keys]
                bins = b.column(wide)
                folds = b.column(fold_at) if by_fold else pa.array(np.zeros(b.num_rows, np.int64))
                groups = [t.group_of(b.column(wide + 1 + i), bins, folds) for i, t in enumerate(shared.value)]
                parts = _partials(b.column(wide + 1 + len(groups)), groups, shared.value, spec)
                if tail_keys is not None:
                    keys = [pa.concat_arrays([a, k]) for a, k in zip(tail_keys, keys)]
                    parts = tuple(np.concatenate([a, p]) for a, p in zip(tail_parts, parts))
                first = _starts(keys, len(keys[0]))
                parts = _merge(first, parts)
                keys = [k.take(pa.array(first)) for k in keys]
                tail_keys, tail_parts = [k.slice(len(first) - 1) for k in keys], tuple(p[-1:] for p in parts)
                if len(first) > 1:
                    yield pa.RecordBatch.from_arrays([k.slice(0, len(first) - 1) for k in keys] + [pa.array(c) for c in _features(tuple(p[:-1] for p in parts), spec)], names=names)
        if tail_keys is not None:
            yield pa.RecordBatch.from_arrays(tail_keys + [pa.array(c) for c in _features(tail_parts, spec)], names=names)

    dealt = rows.repartition(*[F.col(c) for c in row_cols]).sortWithinPartitions(*row_cols)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in row_cols] + [f"`{c}` double" for c in spec.feature_columns()])
    return cut_lineage(arrow_map(dealt, run, schema), "rowfeatures")
