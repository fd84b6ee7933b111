"""Distance joins on a grid: an equi-join on cell keys instead of a loop over all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions import geometry as G
from roadweave.plans.scratch import Scratch


def _box(pts: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _cells(df: DataFrame, side: str, grow: float, cell: float) -> DataFrame:
    x0, y0, x1, y1 = _box(F.col("pts"))
    at = lambda v: F.floor(v / cell).cast("long")
    df = df.where(F.size("pts") > 0).select(F.col("id").alias(f"id_{side}"), F.col("pts").alias(f"pts_{side}"), (x0 - grow).alias(f"x0_{side}"), (y0 - grow).alias(f"y0_{side}"), (x1 + grow).alias(f"x1_{side}"), (y1 + grow).alias(f"y1_{side}"))
    df = df.withColumn(f"x_{side}", at(F.col(f"x0_{side}"))).withColumn(f"y_{side}", at(F.col(f"y0_{side}")))
    return df.withColumn("gx", F.explode(F.sequence(f"x_{side}", at(F.col(f"x1_{side}"))))).withColumn("gy", F.explode(F.sequence(f"y_{side}", at(F.col(f"y1_{side}")))))


#: Cells of a line's box from which on lines are listed by the cells along them.
BOX_CELLS = 64


def line_cells(df: DataFrame, side: str, grow: float, cell: float) -> DataFrame:
    """(id_{side}, gx, gy): the cells along each line and within `grow` of it, in proportion to its length."""
    at = lambda v: F.floor(v / cell).cast("long")
    p = F.col("pts")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda k: F.struct(F.element_at(p, k).alias("p"), F.element_at(p, F.least(k + 1, F.size(p))).alias("q")))
    s = df.where(F.size(p) > 0).select(F.col("id").alias(f"id_{side}"), F.explode(ends).alias("s")).select(f"id_{side}", "s.p", "s.q")
    s = s.withColumn("n", F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("q.x") - F.col("p.x")), F.abs(F.col("q.y") - F.col("p.y"))) / cell)))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    along = lambda c, k: F.col(f"p.{c}") + (F.col(f"q.{c}") - F.col(f"p.{c}")) * k / F.col("n")
    for c in "xy":
        u, v = along(c, F.col("k")), along(c, F.col("k") + 1)
        s = s.withColumn(f"{c}0", at(F.least(u, v) - grow)).withColumn(f"{c}1", at(F.greatest(u, v) + grow))
    s = s.withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1")))
    return s.select(f"id_{side}", "gx", "gy").distinct()


def _sprawls(df: DataFrame, grow: float, cell: float) -> bool:
    x0, y0, x1, y1 = _box(F.col("pts"))
    return not df.where((F.size("pts") > 0) & (((x1 - x0 + 2 * grow) / cell + 1) * ((y1 - y0 + 2 * grow) / cell + 1) > BOX_CELLS)).select("id").limit(1).isEmpty()


def within_join(a: DataFrame, b: DataFrame, radius: float, cell: float | None = None, exact: bool = True) -> DataFrame:
    """(id_a, pts_a, id_b, pts_b) of lines or points at most `radius` apart.

    Boxes are listed by the cells that they touch, a's grown by the radius, and meet by cell; only pairs whose boxes
    overlap are measured. A pair that shares several cells is kept in the first only (the larger of the two lower corners),
    so no distinct is needed. Cells should be about as large as an edge; a crowded cell is an ordinary skewed join key,
    which adaptive execution splits.

    A long line's box touches cells by the square of its length. Where there is any line with a box of more than BOX_CELLS,
    lines are listed by the cells along them instead, ids only; pairs are made distinct and get their geometry back.
    """
    cell = cell or max(4 * radius, 100.0)
    if _sprawls(a, radius, cell) or _sprawls(b, 0.0, cell):
        ids = line_cells(a, "a", radius, cell).join(line_cells(b, "b", 0.0, cell), ["gx", "gy"]).select("id_a", "id_b").distinct()
        geometry = lambda df, side: df.select(F.col("id").alias(f"id_{side}"), F.col("pts").alias(f"pts_{side}"))
        met = ids.join(geometry(a, "a"), "id_a").join(geometry(b, "b"), "id_b").select("id_a", "pts_a", "id_b", "pts_b")
        return met.where(G.line_distance(F.col("pts_a"), F.col("pts_b")) <= radius) if exact else met
    pairs = _cells(a, "a", radius, cell).join(_cells(b, "b", 0.0, cell), ["gx", "gy"])
    pairs = pairs.where((F.col("gx") == F.greatest("x_a", "x_b")) & (F.col("gy") == F.greatest("y_a", "y_b")))
    pairs = pairs.where((F.col("x0_a") <= F.col("x1_b")) & (F.col("x0_b") <= F.col("x1_a")) & (F.col("y0_a") <= F.col("y1_b")) & (F.col("y0_b") <= F.col("y1_a")))
    pairs = pairs.select("id_a", "pts_a", "id_b", "pts_b")
    return pairs.where(G.line_distance(F.col("pts_a"), F.col("pts_b")) <= radius) if exact else pairs


#: Pairs of segments that are measured at once.
MEASURED = 250_000


def _lines(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First segment's place and number of segments of each line (one without length for a single point), and all points."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    p = column.flatten()
    points = np.stack([p.field(k).to_numpy(zero_copy_only=False).astype(float) for k in "xy"])
    return np.cumsum(sizes) - sizes, np.where(sizes == 1, 1, sizes - 1), points


def _foot(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of points to segments, as G.foot takes it."""
    d = b - a
    size = d[0] * d[0] + d[1] * d[1]
    t = np.divide((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1], size, out=np.zeros_like(size), where=size > 0)
    t = np.where(np.isnan(t), 1.0, np.clip(t, 0.0, 1.0))
    x, y = a[0] + t * d[0] - p[0], a[1] + t * d[1] - p[1]
    return x * x + y * y


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def within(a: pa.ListArray, b: pa.ListArray, radius: float) -> np.ndarray:
    """Whether each pair of lines is at most `radius` apart: G.line_distance in arrays, some thousand pairs at once."""
    (at_a, n_a, p), (at_b, n_b, q) = _lines(a), _lines(b)
    ends = np.cumsum(n_a * n_b)
    near, one_a, one_b = np.zeros(len(a), bool), np.diff(at_a, append=p.shape[1]) == 1, np.diff(at_b, append=q.shape[1]) == 1
    for low in range(0, int(ends[-1]) if len(ends) else 0, MEASURED):
        k = np.arange(low, min(low + MEASURED, int(ends[-1])))
        row = np.searchsorted(ends, k, "right")
        k = k - (ends - n_a * n_b)[row]
        i, j = at_a[row] + k // n_b[row], at_b[row] + k % n_b[row]
        s, t, u, v = p[:, i], p[:, np.minimum(i + 1, p.shape[1] - 1)], q[:, j], q[:, np.minimum(j + 1, q.shape[1] - 1)]
        t, v = np.where(one_a[row], s, t), np.where(one_b[row], u, v)
        with np.errstate(invalid="ignore"):
            crossing = (_cross(s, t, u) * _cross(s, t, v) < 0) & (_cross(u, v, s) * _cross(u, v, t) < 0)
            d = np.fmin(np.fmin(_foot(s, u, v), _foot(t, u, v)), np.fmin(_foot(u, s, t), _foot(v, s, t)))
            near[row[np.where(crossing, 0.0, np.sqrt(d)) <= radius]] = True
    return near


def measured(pairs: DataFrame, radius: float) -> DataFrame:
    """The pairs (pts_a, pts_b) that are at most `radius` apart, measured in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(within(batch.column("pts_a"), batch.column("pts_b"), radius)))

    return pairs.mapInArrow(run, pairs.schema)


def nearest_other(points: DataFrame, reach: float = 50.0) -> DataFrame:
    """(id, gap): distance of each (id, x, y) to the nearest other row, null only for a lone row.

    Rows that share their place are 0 apart and need no join. The rest look within `reach`, and those that find nothing
    within four times as much, until all have one: few rows are left by then, and each meets the places around it only.
    """
    scratch = Scratch(points.sparkSession, "nearest")
    places = scratch.table(points.groupBy("x", "y").agg(F.count("*").alias("n")), "places")
    spots = places.select(F.struct("x", "y").alias("id"), F.array(G.point(F.col("x"), F.col("y"))).alias("pts"))
    left, found, step, alone = places.where("n = 1").select("x", "y"), [places.where("n > 1").select("x", "y", F.lit(0.0).alias("gap"))], 0, places.limit(2).count() < 2
    while not alone and not left.isEmpty():
        mine = left.select(F.struct("x", "y").alias("id"), F.array(G.point(F.col("x"), F.col("y"))).alias("pts"))
        d = G.distance(F.col("pts_a")[0], F.col("pts_b")[0])
        near = within_join(mine, spots, reach, cell=max(reach, 1e-6)).where("id_a <> id_b").groupBy("id_a").agg(F.min(d).alias("gap"))
        near = scratch.table(left.join(near.select("id_a.x", "id_a.y", "gap"), ["x", "y"], "left"), f"near-{step}")
        found.append(near.where("gap is not null"))
        left, reach, step = near.where("gap is null").select("x", "y"), 4 * reach, step + 1
    gaps = found[0]
    for more in found[1:]:
        gaps = gaps.unionByName(more)
    return points.join(gaps, ["x", "y"], "left").select("id", "gap")
