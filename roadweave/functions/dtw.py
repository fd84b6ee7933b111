"""Warping of many polyline pairs at once: one numpy program over all pairs with the same vertex counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TOUCH = 1e-3
INF = float("inf")


def vertices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(xy of all vertices, bounds of each row) of an ARRAY<STRUCT<x, y>> column; null rows have no vertices."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    xy = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1) if len(flat) else np.empty((0, 2))
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return xy, np.concatenate(([0], np.cumsum(size)))


def bearing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.mod(np.degrees(np.arctan2(b[..., 0] - a[..., 0], b[..., 1] - a[..., 1])) + 360.0, 360.0)


def turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.abs(a - b)
    return np.minimum(d, 360.0 - d)


def along(line: np.ndarray) -> np.ndarray:
    """(pair, vertex) arc length of each vertex."""
    step = np.sqrt(((line[:, 1:] - line[:, :-1]) ** 2).sum(-1))
    return np.concatenate((np.zeros((len(line), 1)), np.cumsum(step, axis=1)), axis=1)


def project(line: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(pair, point) arc length of the nearest place on the line, the first of equals."""
    at = along(line)
    best, s = np.full(points.shape[:2], INF), np.zeros(points.shape[:2])
    for k in range(line.shape[1] - 1):
        a, d = line[:, None, k], line[:, None, k + 1] - line[:, None, k]
        size = (d * d).sum(-1)
        t = np.clip(np.divide(((points - a) * d).sum(-1), size, out=np.zeros(points.shape[:2]), where=size > 0), 0.0, 1.0)
        gap = ((a + t[..., None] * d - points) ** 2).sum(-1)
        near = gap < best
        best = np.where(near, gap, best)
        s = np.where(near, at[:, None, k] + t * (at[:, None, k + 1] - at[:, None, k]), s)
    return s


def interpolate(line: np.ndarray, s: np.ndarray) -> np.ndarray:
    at = along(line)
    out = np.repeat(line[:, :1], s.shape[1], axis=1)
    for k in range(line.shape[1] - 1):
        size = (at[:, k + 1] - at[:, k])[:, None]
        t = np.clip(np.divide(s - at[:, k : k + 1], size, out=np.zeros_like(s), where=size > 0), 0.0, 1.0)
        inside = s > at[:, k : k + 1]
        out = np.where(inside[..., None], line[:, None, k] + t[..., None] * (line[:, None, k + 1] - line[:, None, k]), out)
    return out


def pool(line: np.ndarray, other: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(arc lengths, xy, number) of a line's vertices and the other's feet from `start` on, TOUCH apart."""
    feet = project(line, other)
    s = np.concatenate((along(line), feet), axis=1)
    xy = np.concatenate((line, interpolate(line, feet)), axis=1)
    s = np.where(s >= start[:, None], s, INF)
    for _ in range(2):  # once by arc length, once more to close the gaps that dropped points leave
        order = np.argsort(s, axis=1, kind="stable")
        s = np.take_along_axis(s, order, 1)
        xy = np.take_along_axis(xy, order[..., None], 1)
        if _ == 0:
            last = np.full(len(s), -INF)
            for k in range(s.shape[1]):
                with np.errstate(invalid="ignore"):
                    keep = s[:, k] - last > TOUCH
                keep &= np.isfinite(s[:, k])
                last = np.where(keep, s[:, k], last)
                s[:, k] = np.where(keep, s[:, k], INF)
    return s, xy, np.isfinite(s).sum(1)


def warp(a: np.ndarray, b: np.ndarray, undirected: bool = False) -> dict[str, np.ndarray]:
    """Metrics of each pair: dtw (mean drift), max, min, overlap (percent of a), matched (metres of a), bearing (difference)."""
    p = len(a)
    out = {"dtw": np.full(p, INF), "max": np.full(p, INF), "min": np.full(p, INF), "overlap": np.zeros(p, np.int64), "matched": np.zeros(p), "bearing": np.zeros(p)}
    if undirected:
        ends = lambda i, j: np.sqrt(((a[:, i] - b[:, j]) ** 2).sum(-1))
        flip = ends(0, -1) + ends(-1, 0) < ends(0, 0) + ends(-1, -1)
        b = np.where(flip[:, None, None], b[:, ::-1], b)
    full = lambda x: bearing(x[:, 0], x[:, -1]) if x.shape[1] > 1 else np.zeros(p)
    out["bearing"] = turn(full(a), full(b))
    if a.shape[1] < 2 or b.shape[1] < 2 or not p:
        return out
    on_b, on_a = project(b, a[:, :1])[:, 0], project(a, b[:, :1])[:, 0]
    only_a, only_b = (on_a > TOUCH) & (on_b <= TOUCH), (on_b > TOUCH) & (on_a <= TOUCH)
    start_a = np.where(only_a | (~only_b & (on_a > on_b)), on_a, 0.0)
    start_b = np.where(only_b | (~only_a & (on_b > on_a)), on_b, 0.0)
    sa, pa_, na = pool(a, b, start_a)
    sb, pb, nb = pool(b, a, start_b)
    n, m = int(na.max()), int(nb.max())
    if not n or not m:
        return out
    gap = np.sqrt(((pa_[:, :n, None] - pb[:, None, :m]) ** 2).sum(-1))
    cost = np.full((p, n, m), INF)
    count, high, low = np.ones((p, n, m), np.int64), gap.copy(), gap.copy()
    real = (np.arange(n)[None, :, None] < na[:, None, None]) & (np.arange(m)[None, None, :] < nb[:, None, None])
    gap = np.where(real, gap, INF)
    cost[:, 0, 0] = gap[:, 0, 0]
    for i in range(n):
        for j in range(m):
            if i == j == 0:
                continue
            ways = [(i - 1, j)] * (i > 0) + [(i, j - 1)] * (j > 0) + [(i - 1, j - 1)] * (i > 0 and j > 0)
            best, c, h, w = (x[:, ways[0][0], ways[0][1]] for x in (cost, count, high, low))
            for y, x in ways[1:]:  # the first of equal ways
                less = cost[:, y, x] < best
                best, c, h, w = (np.where(less, t[:, y, x], o) for t, o in ((cost, best), (count, c), (high, h), (low, w)))
            cost[:, i, j] = gap[:, i, j] + best
            count[:, i, j], high[:, i, j], low[:, i, j] = c + 1, np.maximum(h, high[:, i, j]), np.minimum(w, low[:, i, j])
    ok = (na > 0) & (nb > 0)
    row, la, lb = np.arange(p), np.maximum(na - 1, 0), np.maximum(nb - 1, 0)
    last_row, last_column = cost[row, la], cost[row, :, lb]
    j_end = m - 1 - np.argmin(last_row[:, ::-1], axis=1)  # the last of equal ends, the column before the row
    i_end = n - 1 - np.argmin(last_column[:, ::-1], axis=1)
    column = last_column[row, i_end] <= last_row[row, j_end]
    i, j = np.where(column, i_end, la), np.where(column, lb, j_end)
    total = cost[row, i, j]
    ok &= np.isfinite(total)
    matched = np.where(ok, np.maximum(0.0, np.where(ok, sa[row, i], 0.0) - start_a), 0.0)
    size = along(a)[:, -1]
    share = np.divide(matched, size, out=np.zeros(p), where=size > 0)
    out["dtw"] = np.where(ok, total / count[row, i, j], INF)
    out["max"], out["min"] = np.where(ok, high[row, i, j], INF), np.where(ok, low[row, i, j], INF)
    out["overlap"] = np.where(ok, np.clip(np.rint(share * 100.0), 0, 100), 0).astype(np.int64)
    out["matched"] = matched
    span = turn(bearing(pa_[:, 0], pa_[row, i]), bearing(pb[:, 0], pb[row, j]))
    out["bearing"] = np.where(ok & (count[row, i, j] > 1), span, out["bearing"])
    return out
