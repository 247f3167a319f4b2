"""Factorisation machine with row weights, trained on gradients of the whole table.

Each step is one job: tasks add up the gradient of their rows on flat NumPy buffers, in blocks of
parameters; blocks of the same number are added up in a second round; what reaches the driver is one
gradient, whose size is the model's and does not depend on the rows.  The driver takes an Adam step
with decoupled weight decay.  With a ``model_dir`` the state is saved after every step (as one small
Parquet file in a folder that executors and driver share) and a restarted fit goes on from the last."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_map
from ..session import cut_lineage, path_exists

BLOCK = 8192  # parameters that travel together


def unpack(theta: np.ndarray, n: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) as views of the flat parameters."""
    return theta[0], theta[1:n + 1], theta[n + 1:].reshape(n, -1)


def margins(theta: np.ndarray, n: int, start: np.ndarray, index: np.ndarray, value: np.ndarray):
    """(z, sums of factors [factors, rows], row of each entry, its factors [factors, entries]) of the sparse rows
    that begin at ``start`` (one end behind them)."""
    bias, w, v = unpack(theta, n)
    rows, size = len(start) - 1, np.diff(start)
    row = np.repeat(np.arange(rows), size)
    part = np.ascontiguousarray(v.T)[:, index] * value
    total, some = np.zeros((v.shape[1], rows)), size > 0
    if some.any():
        total[:, some] = np.add.reduceat(part, start[:-1][some], axis=1)
    z = bias + np.bincount(row, w[index] * value, minlength=rows) + 0.5 * ((total ** 2).sum(0) - np.bincount(row, (part ** 2).sum(0), minlength=rows))
    return z, total, row, part


def gradient(theta: np.ndarray, n: int, start, index, value, y, weight) -> tuple[float, np.ndarray]:
    """Weighted log loss of the rows and its gradient, both as sums."""
    z, total, row, part = margins(theta, n, start, index, value)
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
    out = np.zeros_like(theta)
    _, dw, dv = unpack(out, n)
    out[0] = g.sum()
    gx = g[row] * value
    dw += np.bincount(index, gx, minlength=n)
    for f in range(dv.shape[1]):
        dv[:, f] = np.bincount(index, gx * (total[f][row] - part[f]), minlength=n)
    return loss, out


def sparse_rows(df: DataFrame, keep: list, vector: str = "features") -> DataFrame:
    """``keep`` and the indices and values of a vector column that are not zero."""
    v = F.unwrap_udt(F.col(vector))
    dense = v["type"] == 1
    places = F.when(dense, F.sequence(F.lit(0), F.greatest(F.size(v["values"]) - 1, F.lit(0)))).otherwise(v["indices"])
    return df.select(*keep, places.alias("_i"), v["values"].alias("_x"))


def _csr(batch: pa.RecordBatch, at: int):
    index, value = batch.column(at), batch.column(at + 1)
    size = index.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(size)]), index.flatten().to_numpy(zero_copy_only=False).astype(np.int64), value.flatten().to_numpy(zero_copy_only=False)


def table_gradient(rows: DataFrame, theta: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """``gradient`` over a table (y, weight, _i, _x), added up in two rounds."""
    shared = rows.sparkSession.sparkContext.broadcast(theta)
    names = ["block", "part"]

    def tasks(batches):
        total, loss = None, 0.0
        for b in batches:
            start, index, value = _csr(b, 2)
            one, g = gradient(shared.value, n, start, index, value, b.column(0).to_numpy().astype(float), b.column(1).to_numpy())
            total, loss = g if total is None else total + g, loss + one
        if total is not None:
            total = np.append(total, loss)
            for k, a in enumerate(range(0, len(total), BLOCK)):
                cut = total[a:a + BLOCK]
                if cut.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([cut.tobytes()], pa.binary())], names=names)

    def blocks(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cut = np.frombuffer(part)
                sums[k] = sums[k] + cut if k in sums else cut
        for k, cut in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([cut.tobytes()], pa.binary())], names=names)

    parts = arrow_map(arrow_map(rows.select("y", "weight", "_i", "_x"), tasks, "block long, part binary").repartition("block"), blocks, "block long, part binary")
    out = np.zeros(len(theta) + 1)
    for r in parts.collect():  # one gradient
        out[r[0] * BLOCK:(r[0] + 1) * BLOCK] = np.frombuffer(r[1])
    shared.unpersist()
    return float(out[-1]), out[:-1]


@dataclass
class WeightedFM:
    theta: np.ndarray
    n: int
    losses: list

    def score(self, df: DataFrame, keep: list[str], vector: str = "features") -> DataFrame:
        """(keep..., z, p) of every row."""
        shared, n, k = df.sparkSession.sparkContext.broadcast(self.theta), self.n, len(keep)

        def run(batches):
            for b in batches:
                z = margins(shared.value, n, *_csr(b, k))[0]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(z), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*keep, "z", "p"])

        rows = sparse_rows(df, keep, vector)
        schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
        return arrow_map(rows, run, f"{schema}, z double, p double")


def fit(df: DataFrame, label: str, weight: str, num_features: int, factor_size: int = 8, max_iter: int = 30,
        step_size: float = 0.1, reg: float = 1e-3, seed: int = 777, model_dir: str | None = None) -> WeightedFM:
    """``df`` has the vector ``features`` of ``num_features`` entries, a 0/1 label and the row weights; it is
    read once: its sparse rows are written, and every step reads those."""
    spark = df.sparkSession
    rows = cut_lineage(sparse_rows(df, [F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("weight")]), "sparse")
    total = rows.agg(F.sum("weight")).first()[0] or 1.0
    size = 1 + num_features * (1 + factor_size)
    theta = np.zeros(size)
    theta[num_features + 1:] = np.random.default_rng(seed).normal(scale=0.01, size=size - num_features - 1)
    state = [theta, np.zeros(size), np.zeros(size)]
    losses: list[float] = []
    done = 0
    while model_dir and path_exists(spark, f"{model_dir}/step-{done + 1}/_SUCCESS"):
        done += 1
    if done:
        r = spark.read.parquet(f"{model_dir}/step-{done}").first()
        state, losses = [np.frombuffer(r[c]).copy() for c in ("theta", "first", "second")], list(r["losses"])
    theta, first, second = state
    for t in range(done + 1, max_iter + 1):
        loss, g = table_gradient(rows, theta, num_features)
        losses.append(loss / total)
        g /= total
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        theta = theta * (1 - step_size * reg) - step_size * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        if model_dir:
            spark.createDataFrame([(theta.tobytes(), first.tobytes(), second.tobytes(), losses)],
                                  "theta binary, first binary, second binary, losses array<double>").write.mode("overwrite").parquet(f"{model_dir}/step-{t}")
    if not math.isfinite(float(theta.sum())):
        raise ArithmeticError("the fit diverged, take a smaller step")
    return WeightedFM(theta, num_features, losses)
