"""Isolation forest: matches that are odd in all their metrics together."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators.thresholds import DEFAULT_METRICS
from roadweave.plans.scratch import Scratch

#: Rows that a tree is grown from, and rows that trees draw from.
DRAWN, POOL = 256, 1 << 16


def usual_depth(n: int) -> float:
    """Mean depth at which a search in a tree of n rows ends."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, draw: np.random.Generator, deepest: int) -> list[tuple]:
    """Nodes (column, cut, left, right), or (-1, depth, 0, 0) for a leaf; a cut is drawn between a column's least and largest value."""
    nodes: list[tuple] = []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, depth + usual_depth(len(rows)), 0, 0))
        low, high = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(high > low)
        if len(rows) > 1 and depth < deepest and len(open_):
            c = int(draw.choice(open_))
            cut = float(draw.uniform(low[c], high[c]))
            left = rows[:, c] <= cut
            nodes[at] = (c, cut, node(rows[left], depth + 1), node(rows[~left], depth + 1))
        return at

    node(x, 0)
    return nodes


def depths(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Mean depth of each row."""
    total = np.zeros(len(x))
    for t in trees:
        c, cut, left, right = (np.array(v) for v in zip(*t, strict=True))
        at = np.zeros(len(x), np.int64)
        while (inner := c[at] >= 0).any():
            k = at[inner]
            at[inner] = np.where(x[inner, c[k]] <= cut[k], left[k], right[k])
        total += cut[at]
    return total / len(trees)


def isolation_forest_flags(summary: DataFrame, *, metrics: tuple[str, ...] | None = None, contamination: float | str = "auto", random_state: int = 0, n_estimators: int = 300) -> DataFrame:
    """Adds if_outlier and if_score (lower: odder) to matched rows with finite metrics; others get false and null.

    Metrics are scaled to equal spread, those where more is better as 100 less the value. Trees are grown on the driver from
    POOL rows at most, those with the least hash; every row is scored where it is. Fewer than ten rows give no flags. With
    contamination as a share, that share of rows is flagged; "auto" flags rows whose score is below 0. Cuts are drawn by
    another generator than other libraries', so scores agree with theirs only in kind.
    """
    names = [m for m in metrics or DEFAULT_METRICS if m in summary.columns]
    seen = F.col("match_type") != "NO_MATCH" if "match_type" in summary.columns else F.lit(True)
    value = [F.col(m).cast("double") if DEFAULT_METRICS.get(m, "lower") == "lower" else 100.0 - F.col(m).cast("double") for m in names]
    sound = seen
    for v in value:
        sound = sound & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    none = summary.withColumns({"if_outlier": F.lit(False), "if_score": F.lit(None).cast("double")})
    if not names:
        return none
    rows = summary.where(sound).select(*(v.alias(f"m{k}") for k, v in enumerate(value)))
    s = rows.agg(F.count("*").alias("n"), *(f(f"m{k}").alias(f"{n}{k}") for k in range(len(names)) for n, f in (("mean", F.avg), ("std", F.stddev_pop)))).first()
    if s["n"] < 10:
        return none
    mean, std = (np.array([s[f"{n}{k}"] for k in range(len(names))], float) for n in ("mean", "std"))
    std[std == 0] = 1.0
    key = F.xxhash64(*rows.columns)
    pool = np.array(sorted(tuple(r)[1:] for r in rows.withColumn("h", key).orderBy("h", *rows.columns).limit(POOL).select("h", *rows.columns).collect()), float)
    pool = (pool - mean) / std
    draw, size = np.random.default_rng(random_state), min(DRAWN, len(pool))
    trees = [grow(pool[draw.choice(len(pool), size, replace=False)], draw, math.ceil(math.log2(max(size, 2)))) for _ in range(n_estimators)]
    usual = usual_depth(size)

    def score(x: pa.Array) -> pa.Array:
        v = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
        return pa.array(0.5 - 2.0 ** (-depths(trees, (v - mean) / std) / usual))

    scored = F.arrow_udf(score, "double")(F.array(*(F.coalesce(F.when(sound, v), F.lit(0.0)) for v in value)))
    out = summary.withColumn("if_score", F.when(F.coalesce(sound, F.lit(False)), scored))
    cut = 0.0
    if contamination != "auto":
        out = Scratch(summary.sparkSession, "isolation").table(out, "scored")
        cut = out.agg(F.percentile("if_score", float(contamination))).first()[0]
    return out.withColumn("if_outlier", F.coalesce(F.col("if_score") < cut, F.lit(False))).select(*summary.columns, "if_outlier", "if_score")
