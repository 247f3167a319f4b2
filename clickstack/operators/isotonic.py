"""Isotonic fit by merged convex minorants.

The fit of 0/1 labels on a score is the slope of the greatest convex minorant of the points
(labels so far, positives so far) in score order.  The scores are range-partitioned; each task
keeps the minorant of its part.  A point of the whole minorant is the lowest point in some
direction, so for a range of slopes only the corners of each part whose own edges enclose such a
slope can matter.  The slopes are cut into ranges of about equal numbers of edges, the corners of
each range meet in one task, and the edges with slopes in that range are final.  Nothing but corners
leaves a task, and the comparison is exact, in whole numbers.

Class weights change the values, never the pools: a pool's weighted mean rises with its share of
positives."""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import arrow_map
from ..session import cut_lineage

RANGE_EDGES = 200_000  # edges that meet in one task, about


class Minorant:
    """Corners (x, y, payload) of the greatest convex minorant of points given in order of x; points
    on an edge are no corners."""

    def __init__(self):
        self.corners = []

    def add(self, x: int, y: int, payload=None) -> None:
        c = self.corners
        while len(c) > 1 and (c[-1][1] - c[-2][1]) * (x - c[-1][0]) >= (y - c[-1][1]) * (c[-1][0] - c[-2][0]):
            c.pop()
        c.append((x, y, payload))


CORNERS = "part int, x long, y long, at double, next double, left double, right double"


def _corners(batches):
    """Corners of one part in its own coordinates, and a last row (``left`` null) with its totals and
    first score."""
    from pyspark import TaskContext
    hull, x, y, first, held = Minorant(), 0, 0, None, None
    hull.add(0, 0)
    for b in batches:
        for p, n, pos in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if held is not None:
                hull.add(x, y, (held, p))
            first = p if first is None else first
            x, y, held = x + n, y + pos, p
    if held is None:
        return
    hull.add(x, y, (held, None))
    c, part = hull.corners, TaskContext.get().partitionId()
    slope = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(c, c[1:])] + [float("inf")]
    rows = [(part, cx, cy, at, nxt, slope[i], slope[i + 1]) for i, (cx, cy, (at, nxt)) in enumerate(c[1:])]
    rows.append((part, x, y, first, None, None, None))
    names = [f.split(" ")[0] for f in CORNERS.split(", ")]
    schema = pa.schema([(n, pa.int32() if n == "part" else pa.int64() if n in "xy" else pa.float64()) for n in names])
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i:i + 10_000]], schema)


POOLS = "lo double, hi double, n long, pos long"


def _edges(cuts: list[float]):
    """Edges with slopes in the range of their class, from the corners of the classes in order of x."""
    bounds = [None, *map(Fraction, cuts), None]
    schema = pa.schema([("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("pos", pa.int64())])

    def of(cls, c):
        low, high = bounds[cls], bounds[cls + 1]
        out = []
        for (ax, ay, (_, nxt)), (bx, by, (at, _)) in zip(c, c[1:]):
            dx, dy = bx - ax, by - ay
            if (low is None or dy * low.denominator >= low.numerator * dx) and (high is None or dy * high.denominator < high.numerator * dx):
                out.append({"lo": nxt, "hi": at, "n": dx, "pos": dy})
        return pa.RecordBatch.from_pylist(out, schema)

    def run(batches):
        now, hull = None, None
        for b in batches:
            for cls, x, y, at, nxt in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if cls != now:
                    if hull:
                        yield of(now, hull.corners)
                    now, hull = cls, Minorant()
                hull.add(x, y, (at, nxt))
        if hull:
            yield of(now, hull.corners)
    return run


def pools(scores: DataFrame, p: str, n: str, pos: str, range_edges: int = RANGE_EDGES) -> DataFrame:
    """(lo, hi, n, pos): the pools of the fit, from distinct scores ``p`` with ``n`` labels of which ``pos``
    are positive.  NaN and null scores are left out."""
    points = scores.where(F.col(p).isNotNull() & ~F.isnan(p)).select(F.col(p).cast("double").alias("p"), F.col(n).cast("long"), F.col(pos).cast("long"))
    local = cut_lineage(arrow_map(points.repartitionByRange("p").sortWithinPartitions("p"), _corners, CORNERS), "corners")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    after = Window.orderBy(F.desc("part")).rowsBetween(-1, -1)
    parts = cut_lineage(local.where("left is null").select(
        "part", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("x0"), F.coalesce(F.sum("y").over(w), F.lit(0)).alias("y0"),
        F.col("at").alias("first"), F.max("at").over(after).alias("following")), "parts")
    corners = local.where("left is not null").join(F.broadcast(parts), "part").select(
        (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"), "at",
        F.coalesce("next", "following").alias("next"), "left", "right")
    zero = F.lit(0).cast("long")
    origin = parts.groupBy().agg(F.min("first").alias("next")).where("next is not null").select(
        zero.alias("x"), zero.alias("y"), F.lit(None).cast("double").alias("at"), "next",
        F.lit(float("-inf")).alias("left"), F.lit(float("inf")).alias("right"))
    corners = corners.unionByName(origin)
    n_ranges = 1 + corners.count() // range_edges
    cuts = []
    if n_ranges > 1:  # as many numbers as ranges
        at = [i / n_ranges for i in range(1, n_ranges)]
        cuts = sorted(set(corners.agg(F.percentile_approx("left", at, 10 * n_ranges)).first()[0]) - {float("-inf")})
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    first = F.size(F.filter(bounds, lambda c: c < F.col("left")))     # a class of slopes [cut, next cut]
    last = F.size(F.filter(bounds, lambda c: c <= F.col("right")))
    classed = corners.select(F.explode(F.sequence(first, last)).alias("cls"), "x", "y", "at", "next")
    return arrow_map(classed.repartition("cls").sortWithinPartitions("cls", "x"), _edges(cuts), POOLS)
