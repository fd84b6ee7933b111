"""Planar geometry as column expressions over polylines of type ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(pts: Column) -> Column:
    """Array of (a, b): consecutive vertices; empty below two vertices."""
    n = F.size(pts)
    return F.when(n > 1, F.arrays_zip(F.slice(pts, 1, F.greatest(n - 1, F.lit(1))).alias("a"), F.slice(pts, 2, F.greatest(n - 1, F.lit(1))).alias("b"))).otherwise(F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def length(pts: Column) -> Column:
    return F.aggregate(segments(pts), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))


def bearing(a: Column, b: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])) + 360.0, F.lit(360.0))


def line_bearing(pts: Column) -> Column:
    """From the first vertex to the last; 0 below two vertices."""
    return F.when(F.size(pts) > 1, bearing(F.element_at(pts, 1), F.element_at(pts, -1))).otherwise(0.0)


def turn(a: Column, b: Column) -> Column:
    """Difference of two bearings, in [0, 180]."""
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def foot(p: Column, a: Column, b: Column) -> Column:
    """(t, d): where on a-b the nearest point of p lies, as a share of the segment, and its squared distance."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / size))).otherwise(0.0)
    return F.transform(F.array(t), lambda t: F.struct(t.alias("t"), ((a["x"] + t * dx - p["x"]) * (a["x"] + t * dx - p["x"]) + (a["y"] + t * dy - p["y"]) * (a["y"] + t * dy - p["y"])).alias("d")))[0]


def project(pts: Column, p: Column) -> Column:
    """(s, d): arc length of the nearest point of a line, the first of equals, and its distance."""
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("s"), F.lit(0.0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        f, size = foot(p, s["a"], s["b"]), distance(s["a"], s["b"])
        return F.transform(F.array(F.struct(f.alias("f"), size.alias("l"))), lambda q: F.struct(
            F.least(acc["d"], q["f"]["d"]).alias("d"),
            F.when(q["f"]["d"] < acc["d"], acc["at"] + q["f"]["t"] * q["l"]).otherwise(acc["s"]).alias("s"),
            (acc["at"] + q["l"]).alias("at"),
        ))[0]

    return F.aggregate(segments(pts), start, step, lambda acc: F.struct(acc["s"].alias("s"), F.sqrt(acc["d"]).alias("d")))


def interpolate(pts: Column, s: Column) -> Column:
    """The point at an arc length; before the start the first vertex, past the end the last."""
    start = F.struct(F.element_at(pts, 1).alias("p"), F.lit(0.0).alias("at"))

    def step(acc: Column, g: Column) -> Column:
        size = distance(g["a"], g["b"])
        t = F.when(size > 0, F.least(F.lit(1.0), (s - acc["at"]) / size)).otherwise(0.0)
        on = point(g["a"]["x"] + t * (g["b"]["x"] - g["a"]["x"]), g["a"]["y"] + t * (g["b"]["y"] - g["a"]["y"]))
        return F.struct(F.when(s > acc["at"], on).otherwise(acc["p"]).alias("p"), (acc["at"] + size).alias("at"))

    return F.aggregate(segments(pts), start, step, lambda acc: acc["p"])


def cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def segment_distance(s: Column, t: Column) -> Column:
    """0 if two segments properly cross, else the least of the four distances of an end to the other segment."""
    crossing = (cross(s["a"], s["b"], t["a"]) * cross(s["a"], s["b"], t["b"]) < 0) & (cross(t["a"], t["b"], s["a"]) * cross(t["a"], t["b"], s["b"]) < 0)
    ends = F.least(foot(s["a"], t["a"], t["b"])["d"], foot(s["b"], t["a"], t["b"])["d"], foot(t["a"], s["a"], s["b"])["d"], foot(t["b"], s["a"], s["b"])["d"])
    return F.when(crossing, 0.0).otherwise(F.sqrt(ends))


def chain(pts: Column) -> Column:
    """Segments of a line, or a segment without length for a single point."""
    return F.when(F.size(pts) == 1, F.array(F.struct(pts[0].alias("a"), pts[0].alias("b")))).otherwise(segments(pts))


def line_distance(a: Column, b: Column) -> Column:
    return F.array_min(F.flatten(F.transform(chain(a), lambda s: F.transform(chain(b), lambda t: segment_distance(s, t)))))


def from_wkt(wkt: Column, kind: str = "LINESTRING") -> Column:
    """The vertices of a LINESTRING or POINT; null for anything else, Multi* included."""
    body = F.regexp_extract(wkt, rf"(?i)^\s*{kind}\s*(?:Z|M|ZM)?\s*\(([^()]*)\)\s*$", 1)
    xy = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.split(p, r"\s+"))
    return F.when(body != "", F.transform(xy, lambda p: point(F.element_at(p, 1), F.element_at(p, 2))))


def to_wkt(pts: Column) -> Column:
    xy = F.array_join(F.transform(pts, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.when(F.size(pts) == 1, F.lit("POINT (")).otherwise(F.lit("LINESTRING (")), xy, F.lit(")"))


def reversed_line(pts: Column) -> Column:
    return F.reverse(pts)


#: Fixed values of map projections: GRS80 / WGS84 axes and flattenings.
ELLIPSOIDS = {"grs80": (6378137.0, 1 / 298.257222101), "wgs84": (6378137.0, 1 / 298.257223563)}


def projection_of(srid: int) -> tuple[str, float, float, float, float]:
    """(ellipsoid, central meridian, scale, false easting, false northing) of a transverse Mercator grid."""
    if srid == 3006:
        return "grs80", 15.0, 0.9996, 500_000.0, 0.0
    if 32601 <= srid <= 32660:
        return "wgs84", (srid - 32600) * 6.0 - 183.0, 0.9996, 500_000.0, 0.0
    if 32701 <= srid <= 32760:
        return "wgs84", (srid - 32700) * 6.0 - 183.0, 0.9996, 500_000.0, 10_000_000.0
    raise ValueError(f"no transverse Mercator grid is known for SRID {srid}")


def transverse_mercator(lon: Column, lat: Column, srid: int) -> Column:
    """Krueger's series to the fourth order in the third flattening; metres."""
    ellipsoid, meridian, scale, east, north = projection_of(srid)
    axis, f = ELLIPSOIDS[ellipsoid]
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    radius = axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    conformal = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(conformal, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + conformal * conformal))
    x = eta + sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(series, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(series, 1)), F.lit(0.0))
    return point(east + scale * radius * x, north + scale * radius * y)


def from_transverse_mercator(x: Column, y: Column, srid: int) -> Column:
    """Longitude and latitude of a place on the grid: the inverse series, to the fourth order too."""
    ellipsoid, meridian, scale, east, north = projection_of(srid)
    axis, f = ELLIPSOIDS[ellipsoid]
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    radius = axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    xi, eta = (y - north) / (scale * radius), (x - east) / (scale * radius)
    xi0 = xi - sum((b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(series, 1)), F.lit(0.0))
    eta0 = eta - sum((b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(series, 1)), F.lit(0.0))
    conformal = F.asinh(F.sin(xi0) / F.sqrt(F.sinh(eta0) * F.sinh(eta0) + F.cos(xi0) * F.cos(xi0)))
    sine = F.tanh(conformal)
    for _ in range(5):  # isometric latitude to geographic
        sine = F.tanh(conformal + e * F.atanh(e * sine))
    return point(meridian + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(F.asin(sine)))


def to_degrees(pts: Column, srid: int | None) -> Column:
    """Vertices in metres of a grid to (longitude, latitude); None leaves them as they are."""
    return pts if srid is None else F.transform(pts, lambda p: from_transverse_mercator(p["x"], p["y"], srid))


def to_metres(pts: Column, srid: int | None, always_xy: bool = True) -> Column:
    """Vertices in degrees to metres of a grid; None leaves them as they are."""
    if srid is None:
        return pts
    return F.transform(pts, lambda p: transverse_mercator(p["x"] if always_xy else p["y"], p["y"] if always_xy else p["x"], srid))
