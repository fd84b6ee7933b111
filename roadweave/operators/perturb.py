"""Perturbed copies of edges, as array expressions, and sweeps of a match over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions import geometry as G

#: Fixed order in which several perturbations of one edge are applied.
ORDER = ("crop", "stretch", "rotate", "translate", "shift", "longitudinal", "noise", "reverse")


def _moved(pts: Column, dx: Column, dy: Column) -> Column:
    return F.transform(pts, lambda p: G.point(p["x"] + dx, p["y"] + dy))


def _middle(pts: Column) -> tuple[Column, Column]:
    n = F.size(pts)
    return tuple(F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p[c]) / n for c in ("x", "y"))  # noqa: B023


def translate(pts: Column, metres: float, heading: float) -> Column:
    """Along a compass heading."""
    return _moved(pts, metres * F.sin(F.radians(F.lit(heading))), metres * F.cos(F.radians(F.lit(heading))))


def shift(pts: Column, metres: float) -> Column:
    """To the left of the line's chord."""
    b = F.radians(G.line_bearing(pts))
    return _moved(pts, -metres * F.cos(b), metres * F.sin(b))


def longitudinal(pts: Column, metres: float) -> Column:
    b = F.radians(G.line_bearing(pts))
    return _moved(pts, metres * F.sin(b), metres * F.cos(b))


def rotate(pts: Column, degrees: float) -> Column:
    """Counter-clockwise about the mean of the vertices."""
    (cx, cy), a = _middle(pts), F.radians(F.lit(degrees))
    return F.transform(pts, lambda p: G.point(cx + (p["x"] - cx) * F.cos(a) - (p["y"] - cy) * F.sin(a), cy + (p["x"] - cx) * F.sin(a) + (p["y"] - cy) * F.cos(a)))


def stretch(pts: Column, factor: float) -> Column:
    cx, cy = _middle(pts)
    return F.transform(pts, lambda p: G.point(cx + (p["x"] - cx) * factor, cy + (p["y"] - cy) * factor))


def crop(pts: Column, share: float) -> Column:
    """Without `share` of the length, half at each end."""
    size = G.length(pts)
    lo, hi = size * share / 2, size * (1 - share / 2)
    cut = F.aggregate(G.segments(pts), F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<s:double,p:struct<x:double,y:double>>>").alias("v")), lambda acc, s: F.struct((acc["at"] + G.distance(s["a"], s["b"])).alias("at"), F.array_append(acc["v"], F.struct((acc["at"] + G.distance(s["a"], s["b"])).alias("s"), s["b"].alias("p"))).alias("v")), lambda acc: acc["v"])
    inner = F.transform(F.filter(cut, lambda v: (v["s"] > lo + 1e-9) & (v["s"] < hi - 1e-9)), lambda v: v["p"])
    return F.concat(F.array(G.interpolate(pts, lo)), inner, F.array(G.interpolate(pts, hi)))


def noise(pts: Column, metres: float, seed: int = 0) -> Column:
    """Normal noise for each vertex, from hashes of the seed, its place in the line and its coordinates."""
    def draw(p: Column, i: Column, k: int) -> Column:  # noqa: E306
        u = lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k * 2 + j), i, p["x"], p["y"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return metres * F.sqrt(-2.0 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    return F.transform(pts, lambda p, i: G.point(p["x"] + draw(p, i, 0), p["y"] + draw(p, i, 1)))


def resample(pts: Column, step: float) -> Column:
    """Equal steps of about `step` metres."""
    size = G.length(pts)
    n = F.greatest(F.lit(1), F.round(size / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: G.interpolate(pts, size * k / n))


FAMILIES = {"shift": shift, "longitudinal": longitudinal, "rotate": rotate, "crop": crop, "stretch": stretch, "noise": noise, "resample": resample}


def perturb(pts: Column, **by) -> Column:
    """Several perturbations in the fixed order; translate takes (metres, heading), reverse takes True."""
    if unknown := set(by) - set(ORDER):
        raise ValueError(f"unknown perturbations {sorted(unknown)}")
    for name in ORDER:
        if name in by and by[name] not in (None, False):
            pts = G.reversed_line(pts) if name == "reverse" else translate(pts, *by[name]) if name == "translate" else FAMILIES[name](pts, by[name])
    return pts


def sweep(edges: DataFrame, grids: dict[str, list[float]]) -> DataFrame:
    """(id, family, magnitude, pts): every edge under every magnitude of every family, by exploding a short list."""
    copies = [F.struct(F.lit(f).alias("family"), F.lit(float(m)).alias("magnitude"), FAMILIES[f](F.col("pts"), m).alias("pts")) for f, ms in grids.items() for m in ms]
    return edges.select("id", F.explode(F.array(*copies)).alias("c")).select("id", "c.family", "c.magnitude", "c.pts")


def first_change(routes: DataFrame) -> DataFrame:
    """The least magnitude of each (id, family) at which the route changes, and at which there is none, from rows (id, family, magnitude, dest_ids, base_ids)."""
    m = F.abs("magnitude")
    return routes.groupBy("id", "family").agg(F.min(F.when(~F.col("dest_ids").eqNullSafe(F.col("base_ids")), m)).alias("changed_at"), F.min(F.when(F.col("dest_ids").isNull(), m)).alias("lost_at"), F.countDistinct("dest_ids").alias("routes"))
