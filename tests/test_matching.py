import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions import dtw
from roadweave.functions import geometry as G
from roadweave.operators import pairs, points, resolve, spatial
from roadweave.operators.components import connected_components
from roadweave.sources import edges

from .conftest import lines

#: A street of about 600 m in two directions, and another far off, in degrees of zone 33 north.
A = {"main": [(15.2, 58.4), (15.2, 58.4054)], "far": [(15.35, 58.45), (15.35, 58.4552)]}
B = {"low": [(15.20015, 58.4), (15.20015, 58.4027)], "high": [(15.20015, 58.4027), (15.20015, 58.4054)], "down": [(15.20015, 58.4054), (15.20015, 58.4)], "other": [(15.6, 58.6), (15.6, 58.606)]}
ZONE = 32633


def slow_warp(a, b):
    """The same rules, one pair at a time."""
    d = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    cum = lambda l: [sum(d(l[k], l[k + 1]) for k in range(i)) for i in range(len(l))]  # noqa: E731, E741

    def proj(line, p):
        best, s, at = float("inf"), 0.0, 0.0
        for u, v in zip(line, line[1:], strict=False):
            w = d(u, v)
            t = max(0.0, min(1.0, ((p[0] - u[0]) * (v[0] - u[0]) + (p[1] - u[1]) * (v[1] - u[1])) / (w * w))) if w else 0.0
            g = d(p, (u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
            if g < best:
                best, s = g, at + t * w
            at += w
        return s

    def on(line, s):
        at = 0.0
        for u, v in zip(line, line[1:], strict=False):
            w = d(u, v)
            if s <= at + w and w:
                return (u[0] + (s - at) / w * (v[0] - u[0]), u[1] + (s - at) / w * (v[1] - u[1]))
            at += w
        return line[-1]

    sb, sa = proj(b, a[0]), proj(a, b[0])
    if sa > 1e-3 and sb <= 1e-3:
        xa, xb = sa, 0.0
    elif sb > 1e-3 and sa <= 1e-3:
        xa, xb = 0.0, sb
    else:
        xa, xb = (sa if sa > sb else 0.0), (sb if sb > sa else 0.0)

    def pool(l, other, start):  # noqa: E741
        got = [(s, p) for s, p in zip(cum(l), l, strict=True) if s >= start] + [(s, on(l, s)) for s in (proj(l, q) for q in other) if s >= start]
        out = []
        for s, p in sorted(got, key=lambda x: x[0]):
            if not out or s - out[-1][0] > 1e-3:
                out.append((s, p))
        return out

    pa, pb = pool(a, b, xa), pool(b, a, xb)
    cost = {}
    for i in range(len(pa)):
        for j in range(len(pb)):
            ways = [cost[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in cost]
            cost[i, j] = d(pa[i][1], pb[j][1]) + (min(ways) if ways else 0.0)
    best, end = float("inf"), None
    for k in [(len(pa) - 1, j) for j in range(len(pb))] + [(i, len(pb) - 1) for i in range(len(pa))]:
        if cost[k] <= best:
            best, end = cost[k], k
    path, k = [end], end
    while k != (0, 0):
        k = min([q for q in ((k[0] - 1, k[1]), (k[0], k[1] - 1), (k[0] - 1, k[1] - 1)) if q in cost], key=lambda q: cost[q])
        path.append(k)
    gaps = [d(pa[i][1], pb[j][1]) for i, j in path]
    return sum(gaps) / len(gaps), max(gaps), min(gaps), pa[end[0]][0] - xa


def test_warp_equals_the_slow_form():
    draw = random.Random(4)
    for _ in range(300):
        n, m = draw.randint(2, 5), draw.randint(2, 5)
        a = [(draw.uniform(0, 50), draw.uniform(0, 10)) for _ in range(n)]
        b = [(draw.uniform(0, 50), draw.uniform(0, 10)) for _ in range(m)]
        got = dtw.warp(np.array([a]), np.array([b]))
        want = slow_warp(a, b)
        for k, v in zip(("dtw", "max", "min", "matched"), want, strict=True):
            assert got[k][0] == pytest.approx(v, abs=1e-6)


def test_reversed_lines_agree_undirected():
    a, b = np.array([[(0, 0), (100, 0)]], float), np.array([[(100, 2), (0, 2)]], float)
    assert dtw.warp(a, b, undirected=True)["dtw"][0] == pytest.approx(2.0)
    assert dtw.warp(a, b, undirected=True)["bearing"][0] == pytest.approx(0.0)


def test_edge_pairs(spark):
    a, b = lines(spark, A, ZONE), lines(spark, B, ZONE)
    m = pairs.match(a, b, 20.0)
    rows = m.collect()
    assert {(r.source_id, r.dest_id) for r in rows} == {("main", "low"), ("main", "high"), ("main", "down"), ("far", None)}
    assert len([r for r in rows if r["rank"] == 1]) == 1
    gated = [r for r in pairs.match(a, b, 20.0, max_angle=90.0).collect() if r.source_id == "main"]
    assert {r.dest_id for r in gated} == {"low", "high"}  # the opposite direction is out
    lost = [r for r in rows if r.source_id == "far"][0]
    assert lost.match_type == "NO_MATCH" and lost.dtw_distance is None and lost["rank"] is None
    best = resolve.resolve(m, "best_per_source").collect()
    assert sorted((r.source_id, r["rank"]) for r in best) == [("far", None), ("main", 1)]
    one = [r for r in resolve.resolve(m, "one_to_one").collect() if r.dest_id]
    assert len({r.dest_id for r in one}) == len(one) == 1
    assert {(r.source_id, r.dest_id) for r in resolve.resolve(m, "best_per_dest").collect() if r.dest_id} == {("main", "low"), ("main", "high"), ("main", "down")}
    assert resolve.resolve(m, "all").count() == 4
    with pytest.raises(ValueError):
        resolve.resolve(m, "some")
    assert [r.dest_id for r in pairs.unmatched_destinations(m, b).collect()] == ["other"]


def test_each_answer_warps_once(spark):
    """One kernel and, but for the candidates, one join in the plan of every decision."""
    a, b = lines(spark, A, ZONE), lines(spark, B, ZONE)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for strategy in ("all", "best_per_source", "best_per_dest"):
        p = plan(resolve.resolve(pairs.match(a, b, 20.0), strategy))
        assert p.count("MapInArrow") == 1 and p.count("Join ") == 2
        p = plan(resolve.resolve(points.match_points(a, b, 20.0), strategy))
        assert p.count("Join ") == 2


def test_decisions_equal_plain_ones(spark):
    draw = random.Random(6)
    rows = [(s, d, float(draw.randint(1, 6)), k, "x") for s in range(40) for k, d in enumerate(draw.sample(range(18), draw.randint(0, 4)))]
    rows += [(s, None, None, None, "NO_MATCH") for s in range(40) if s not in {r[0] for r in rows}]
    df = spark.createDataFrame(rows, "source_id long, dest_id long, dtw_distance double, rank long, match_type string")
    ok = [r for r in rows if r[1] is not None]
    by = {"all": ok, "best_per_source": [min((r for r in ok if r[0] == s), key=lambda r: (r[2], r[1])) for s in {r[0] for r in ok}], "best_per_dest": [min((r for r in ok if r[1] == d), key=lambda r: (r[2], r[0])) for d in {r[1] for r in ok}]}
    for strategy, kept in by.items():
        lost = [(s, None, None, None, "NO_MATCH") for s in {r[0] for r in rows} - {r[0] for r in kept}]
        assert sorted(map(repr, map(tuple, resolve.resolve(df, strategy).collect()))) == sorted(map(repr, [*kept, *lost]))


def test_one_to_one_equals_greedy(spark):
    draw = random.Random(2)
    rows = [(s, d, float(draw.randint(1, 9)), 1, "x") for s in range(30) for d in draw.sample(range(25), 4)]
    df = spark.createDataFrame(rows, "source_id long, dest_id long, dtw_distance double, rank long, match_type string")
    used_s, used_d, want = set(), set(), set()
    for s, d, *_ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if s not in used_s and d not in used_d:
            used_s.add(s), used_d.add(d), want.add((s, d))
    assert {(r.source_id, r.dest_id) for r in resolve.resolve(df, "one_to_one").collect() if r.dest_id is not None} == want


def test_symmetric(spark):
    """One street with one twin, one with two halves, one that only touches the end of another."""
    a = lines(spark, {"twin": [(15.2, 58.4), (15.2, 58.4054)], "halved": [(15.22, 58.4), (15.22, 58.4054)], "touch": [(15.26, 58.4), (15.26, 58.4054)]}, ZONE)
    b = lines(spark, {"t": [(15.20015, 58.4054), (15.20015, 58.4)], "h1": [(15.22015, 58.4), (15.22015, 58.4027)], "h2": [(15.22015, 58.4027), (15.22015, 58.4054)], "past": [(15.26015, 58.40537), (15.26015, 58.41)]}, ZONE)
    rows = {(r.a_id, r.b_id): r for r in pairs.match_symmetric(a, b, 25.0, max_dtw=12.0).collect()}
    assert set(rows) == {("twin", "t"), ("halved", "h1"), ("halved", "h2")}
    assert (rows["twin", "t"].relation, rows["twin", "t"].cardinality) == ("1:1", "1:1")
    assert {(rows["halved", k].relation, rows["halved", k].cardinality) for k in ("h1", "h2")} == {("split", "1:N_SPLIT")}
    assert all(r.matched_len_m >= 5 for r in rows.values())


def test_both_ways_equal_each_way(spark):
    draw = random.Random(3)
    line = lambda: [(draw.uniform(0, 60), draw.uniform(0, 20)) for _ in range(draw.randint(1, 4))]
    x, y = lines(spark, {k: line() for k in range(30)}), lines(spark, {k: line() for k in range(30)})
    c = spatial.within_join(x, y, 15.0).persist()
    both = {(r.a_id, r.b_id): r for r in pairs.evaluate_both_ways(c).collect()}
    there = {(r.id_a, r.id_b): r for r in pairs.evaluate(c, True).collect()}
    back = {(r.id_b, r.id_a): r for r in pairs.evaluate(c.selectExpr("id_b id_a", "pts_b pts_a", "id_a id_b", "pts_a pts_b"), True).collect()}
    assert both.keys() == there.keys() == back.keys() and len(both) > 100
    for k, r in both.items():
        assert (r.da, r.turn, r.ov_ab, r.ma) == (there[k].dtw_distance, there[k].bearing_diff, there[k].overlap_pct, there[k].matched_len)
        assert (r.db, r.ov_ba, r.mb) == (back[k].dtw_distance, back[k].overlap_pct, back[k].matched_len)


def test_points(spark):
    """Points beside two carriageways that run in opposite directions, by compass and metres."""
    p = lines(spark, {1: [(3, 40)], 2: [(9, 130)], 3: [(400, 40)], 4: [(0.5, 214)], 5: [(0, 0)]})
    e = lines(spark, {"up": [(0, 0), (0, 200)], "down": [(12, 200), (12, 0)], "remote": [(900, 0), (900, 200)]})
    m = points.match_points(p, e, 20.0)
    by = {(r.source_id, r.dest_id): r for r in m.collect()}
    n = by[1, "up"]
    assert (n.distance_m, n.position_pct, n.edge_bearing_deg, n.match_type, n["rank"]) == (3.0, 20.0, 0.0, "1:N_CANDIDATES", 1)
    assert (by[2, "down"].edge_bearing_deg, by[2, "down"].position_pct) == (180.0, 35.0)
    assert by[4, "up"].position_pct == 100.0 and by[4, "up"].distance_m == pytest.approx(math.hypot(0.5, 14)) and by[4, "up"].snap_wkt == "POINT (0.0 200.0)"
    assert by[3, None].match_type == "NO_MATCH" and by[3, None]["rank"] is None and by[5, "up"].distance_m == 0.0
    one = {r.source_id: r.dest_id for r in resolve.resolve(m, "one_to_one").collect()}
    assert one == {5: "up", 2: "down", 1: None, 3: None, 4: None}
    none = points.match_points(p.where("id = 3"), e, 20.0)
    assert none.columns == list(points.COLUMNS) and [r.match_type for r in none.collect()] == ["NO_MATCH"]


def test_nearest_other_equals_all_pairs(spark):
    draw = random.Random(8)
    xy = [(draw.gauss(0, 30), draw.gauss(0, 30)) for _ in range(60)] + [(4000.0, 4000.0), (-90000.0, 7.0), (5.0, 5.0), (5.0, 5.0)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {r.id: r.gap for r in spatial.nearest_other(df, 3.0).collect()}
    want = {k: min(math.dist(p, q) for j, q in enumerate(xy) if j != k) for k, p in enumerate(xy)}
    assert got == pytest.approx(want)
    assert [r.gap for r in spatial.nearest_other(df.limit(1), 3.0).collect()] == [None] and spatial.nearest_other(df.limit(0), 3.0).count() == 0


def test_within_join_equals_all_pairs(spark):
    draw = random.Random(7)
    line = lambda: [(draw.uniform(-300, 300), draw.uniform(-300, 300)) for _ in range(draw.randint(1, 4))]
    a, b = {k: line() for k in range(25)}, {k: line() for k in range(25)}
    x, y = lines(spark, a), lines(spark, b)
    brute = x.selectExpr("id id_a", "pts pts_a").crossJoin(y.selectExpr("id id_b", "pts pts_b")).where(G.line_distance(F.col("pts_a"), F.col("pts_b")) <= 30.0)
    want = sorted((r.id_a, r.id_b) for r in brute.collect())
    for cell in (17.0, 120.0, 5000.0):
        j = spatial.within_join(x, y, 30.0, cell)
        assert sorted((r.id_a, r.id_b) for r in j.collect()) == want
    plan = spatial.within_join(x, y, 30.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_components(spark):
    draw = random.Random(9)
    pairs_ = [(draw.randint(0, 200), draw.randint(0, 200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)]
    root = {k: k for p in pairs_ for k in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs_:
        u, v = find(u), find(v)
        root[max(u, v)] = min(u, v)
    got = connected_components(spark.createDataFrame(pairs_, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {k: find(k) for k in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text('id,oneway,geometry\n1,no,"LINESTRING (0 0, 10 0)"\n2,-1,"LINESTRING (0 0, 0 5, 1 5)"\n3,yes,"MULTILINESTRING ((0 0, 1 1))"\n4,,"LINESTRING (0 0, 1 1)"\n')
    e = edges.read_wkt_csv(spark, str(tmp_path / "e.csv"), "id", keep=("oneway",))
    assert {r.id: r.pts and len(r.pts) for r in e.collect()} == {1: 2, 2: 3, 3: None, 4: 2}
    d = {(r.original_edge_id, r.is_reverse): r.pts for r in edges.directed(e).collect()}
    assert set(d) == {(1, False), (1, True), (2, True), (3, False)} and (d[1, True][0].x, d[2, True][0].y) == (10.0, 5.0)
    (tmp_path / "e.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"7","name":"x"},"geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]}},{"type":"Feature","properties":{"id":"8"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    g = {r.id: r.pts for r in edges.read_geojson(spark, str(tmp_path / "e.geojson"), "id", id_cast="long").collect()}
    assert g[7][1].y == 4.0 and g[8] is None
    edges.to_wkt_csv(e.where("id < 3"), str(tmp_path / "out"))
    assert {r.id: len(r.pts) for r in edges.read_wkt_csv(spark, str(tmp_path / "out"), "id").collect()} == {1: 2, 2: 3}
    assert '"type":"Feature"' in edges.to_geojson_rows(e.where("id = 1")).first().feature


def test_geopackage(spark, tmp_path):
    import sqlite3
    import struct

    from roadweave.sources.geopackage import read_geopackage

    def blob(points, kind=2, order="<", envelope=0, width=2):
        head = b"GP\0" + bytes([(envelope << 1) | (order == "<")]) + struct.pack(order + "i", 4326) + b"\0" * {0: 0, 1: 32}[envelope]
        body = b"".join(struct.pack(order + "d" * width, *p) for p in points)
        return head + bytes([order == "<"]) + struct.pack(order + "I", kind) + (struct.pack(order + "I", len(points)) if kind % 1000 != 1 else b"") + body

    con = sqlite3.connect(tmp_path / "roads.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'the geom')")
    con.execute('CREATE TABLE roads (fid INTEGER, "the geom" BLOB, name TEXT)')
    rows = [(1, blob([(1, 2), (3, 4)]), "x"), (2, blob([(1, 2, 9), (5, 6, 9)], kind=1002, order=">", envelope=1, width=3), None), (3, blob([(7, 8)], kind=1), "point"), (4, None, "none")]
    con.executemany("INSERT INTO roads VALUES (?, ?, ?)", rows)
    con.commit()
    con.close()
    got = {r.id: (r.pts and [(p.x, p.y) for p in r.pts], r.name) for r in read_geopackage(spark, str(tmp_path / "roads.gpkg"), "fid", keep=("name",)).collect()}
    assert got == {1: ([(1, 2), (3, 4)], "x"), 2: ([(1, 2), (5, 6)], None), 3: (None, "point"), 4: (None, "none")}
    assert [r.id for r in read_geopackage(spark, str(tmp_path / "roads.gpkg"), "fid", layer="roads", kind="POINT").where("pts is not null").collect()] == [3]


def test_facade(spark):
    from roadweave.matcher import Matcher

    wkt = lambda rows: spark.createDataFrame([(k, "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in v) + ")") for k, v in rows.items()], "edge_id string, geometry string")
    m = Matcher.from_frames(wkt(A), wkt(B), id_a="edge_id", id_b="edge_id", utm_srid=ZONE)
    tight = m.set_parameters(max_distance=20.0, max_angle=90.0)
    assert (m.max_distance, tight.max_distance) == (25.0, 20.0)
    assert {r.dest_id for r in tight.match().collect()} == {"low", "high", None} and m.match().count() == 4
    long, summary = tight.match_routes()
    assert {r.source_id: r.match_type for r in tight.resolve_routes(summary, long, max_match_dist=15.0)[0].collect()} == {"main": "1:N_ROUTE", "far": "NO_MATCH"}
    assert m.validate_b_geometry()[0].first().n_endpoints == 8


def test_one_way_rows(spark):
    rows = spark.createDataFrame([(1, "Yes", "x"), (2, "no", "Roundabout"), (3, None, None), (4, "-1", "circular")], "id long, oneway string, junction string")
    assert [(r.o, r.j) for r in rows.select("id", edges.is_oneway("oneway").alias("o"), edges.is_roundabout("junction").alias("j")).orderBy("id").collect()] == [(True, False), (False, True), (False, False), (True, True)]
    e = lines(spark, {1: [(0, 0), (1, 0)], 2: [(0, 0), (2, 0)], 3: [(0, 0), (3, 0)]}).join(rows.select("id", F.col("oneway")), "id").withColumn("oneway", F.when(F.col("id") == 2, "no").otherwise("yes"))
    d = edges.directed(e)
    assert sorted(r.original_edge_id for r in edges.one_direction(d).collect()) == [1, 3]
    assert [(r.original_edge_id, r.is_reverse) for r in edges.two_directions(d).collect()] == [(2, False)]
    assert [(r.directed_number, r.original_edge_id, r.is_reverse) for r in edges.numbered(d).orderBy("directed_number").collect()] == [(1, 1, False), (2, 2, False), (3, 2, True), (4, 3, False)]


def test_inverse_projection(spark):
    draw = random.Random(1)
    for srid, lon in ((3006, 15.0), (32633, 15.0), (32720, -63.0)):
        places = [(lon + draw.uniform(-3, 3), draw.uniform(1, 70) * (-1 if srid > 32700 else 1)) for _ in range(50)]
        df = spark.createDataFrame(places, "lon double, lat double").withColumn("m", G.transverse_mercator(F.col("lon"), F.col("lat"), srid))
        for r in df.select("lon", "lat", G.from_transverse_mercator(F.col("m.x"), F.col("m.y"), srid).alias("d")).collect():
            assert (r.d.x, r.d.y) == pytest.approx((r.lon, r.lat), abs=1e-8)


def test_projection(spark):
    # On the central meridian the easting is the false easting; a degree of latitude is about 111 km.
    r = spark.range(1).select(G.transverse_mercator(F.lit(15.0), F.lit(60.0), 3006).alias("p"), G.transverse_mercator(F.lit(15.0), F.lit(61.0), 3006).alias("q"), G.transverse_mercator(F.lit(51.4), F.lit(35.7), 32639).alias("t")).first()
    assert r.p.x == pytest.approx(500_000.0) and r.q.y - r.p.y == pytest.approx(111_420 * 0.9996, rel=2e-3)
    assert r.t.x == pytest.approx(536_184.6, abs=30) and r.t.y == pytest.approx(3_950_800, abs=300)
    with pytest.raises(ValueError):
        G.projection_of(4326)


def test_single_path(spark):
    rows = [("ok", [(0, 0), (5, 0)]), ("ok", [(5, 0), (9, 0)]), ("fork", [(0, 0), (5, 0)]), ("fork", [(5, 0), (9, 0)]), ("fork", [(5, 0), (5, 9)]), ("gap", [(0, 0), (5, 0)]), ("gap", [(50, 0), (60, 0)]), ("one", [(0, 0), (0, 0.1)])]
    df = spark.createDataFrame([(g, [{"x": float(x), "y": float(y)} for x, y in p]) for g, p in rows], f"group string, pts {G.LINE}")
    assert {r.group: r.valid for r in pairs.single_path(df).collect()} == {"ok": True, "fork": False, "gap": False, "one": True}


def test_long_lines_are_listed_by_the_cells_along_them(spark):
    from roadweave.operators import spatial

    diagonal = {1: [(0, 0), (100_000, 100_000)]}
    assert spatial.line_cells(lines(spark, diagonal), "a", 25.0, 100.0).count() < 10_000
    draw = random.Random(4)
    near = {k: [(x := draw.uniform(0, 100_000)) and (x + draw.uniform(-60, 60), x), (x + draw.uniform(-60, 60), x + 30)] for k in range(10, 200)}
    road = {1: [(0, 0), (50_000, 50_000), (100_000, 100_000)], 2: [(5, 5)], 3: [(40_000, 0), (40_000, 90_000)], 4: [(-300, -300), (-200, -300)]}
    got = {(r.id_a, r.id_b) for r in spatial.within_join(lines(spark, road), lines(spark, near), 25.0).collect()}

    def apart(p, q):
        from_point = lambda a, b, c: (lambda d, t: math.dist((a[0] + t * d[0], a[1] + t * d[1]), c))((d := (b[0] - a[0], b[1] - a[1])), max(0.0, min(1.0, ((c[0] - a[0]) * d[0] + (c[1] - a[1]) * d[1]) / ((d[0] ** 2 + d[1] ** 2) or 1.0))))
        cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        best = math.inf
        for a, b in zip(p, p[1:] or p, strict=False):
            for c, d in zip(q, q[1:] or q, strict=False):
                if cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0:
                    return 0.0
                best = min(best, from_point(a, b, c), from_point(a, b, d), from_point(c, d, a), from_point(c, d, b))
        return best

    want = {(i, j) for i, p in road.items() for j, q in near.items() if apart(p, q) <= 25.0}
    assert got == want and len(want) > 20
    assert spatial.within_join(lines(spark, road), lines(spark, near), 25.0).columns == ["id_a", "pts_a", "id_b", "pts_b"]


def test_chains_of_rising_scores_need_few_rounds(spark, monkeypatch):
    n = 2000
    rows = [(k, k, float(2 * k)) for k in range(n)] + [(k, k + 1, float(2 * k + 1)) for k in range(n)]
    rows += [(10_000 + k, 10_000 + k % 7, float(k % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "source_id long, dest_id long, distance_m double")
    sources, dests, want = set(), set(), set()
    for s, d, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if s not in sources and d not in dests:
            sources.add(s)
            dests.add(d)
            want.add((s, d))
    assert {(r.source_id, r.dest_id) for r in resolve.one_to_one(df, "distance_m").collect()} == want
    monkeypatch.setattr(resolve, "COMPONENT", 30)  # larger ones go on in rounds
    few = df.where("source_id >= 10000 or source_id < 12")
    assert {(r.source_id, r.dest_id) for r in resolve.one_to_one(few, "distance_m").collect()} == {(s, d) for s, d in want if s >= 10_000 or s < 12}
