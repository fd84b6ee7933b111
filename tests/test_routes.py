import math

import numpy as np
import pytest

from roadweave.functions.route import match_route
from roadweave.operators import routes

from .conftest import lines

STREET = [(10, -5), (10, 43)]
CUT = {"p": [(10.3, -5), (10.3, 8)], "q": [(10.3, 8), (10.3, 27)], "r": [(10.3, 27), (10.3, 43)]}


def go(a, b, **more):
    return match_route(a, list(b.items()), **{"snap": 0.5, "step": 2, **more})


def names(r):
    return [e["dest_id"] for e in r["edges"]] if r else []


def turned(line, degrees, by=(0.0, 0.0)):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(c * x - s * y + by[0], s * x + c * y + by[1]) for x, y in line]


@pytest.mark.parametrize("degrees", [0, 37, 110, 245])
def test_scenarios(degrees):
    """Whatever way the street runs."""
    to = lambda line: turned(line, degrees, (400, -90))
    run = lambda a, b, **more: go(to(a), {k: to(v) for k, v in b.items()}, **more)
    r = run(STREET, CUT)
    assert names(r) == ["p", "q", "r"] and r["overlap_pct"] == 100 and r["dtw_distance"] < 0.6
    beside = {**CUT, "beside": [(17, -5), (17, 43)]}
    assert names(run(STREET, beside)) == ["p", "q", "r"] and names(run([(x + 6.5, y) for x, y in STREET], beside)) == ["beside"]
    assert names(run(STREET, {**CUT, "whole": [(8.6, -5), (8.6, 43)]})) == ["p", "q", "r"]
    bend = [(0, 0), (0, 21), (-24, 21)]
    assert names(run(bend, {"up": [(0, 0), (0, 21)], "left": [(0, 21), (-24, 21)], "right": [(0, 21), (24, 21)]})) == ["up", "left"]
    loop = run([(0, 0), (12, 0), (26, 0)], {"to": [(0, 0), (12, 0)], "off": [(12, 0), (12, 7)], "home": [(12, 7), (0, 0)], "on": [(12, 0), (26, 0)]})
    assert names(loop)[0] == "to" and "on" in names(loop) and loop["dtw_distance"] < 1
    assert names(run([(0, 0), (12, 0), (26, 0)], {"to": [(0, 0), (12, 0)], "on": [(12, 0), (26, 0)], "side": [(12, 9), (12, 0)]})) == ["to", "on"]
    short = run([(0, 0), (50, 0)], {"m": [(8, 0.3), (25, 0.3)], "n": [(25, 0.3), (42, 0.3)]})
    assert names(short) == ["m", "n"] and short["overlap_pct"] < 100
    assert len(names(run(STREET, {"p": [(10.3, -5), (10.3, 17)], "q": [(10.3, 20), (10.3, 43)]}))) < 2
    gap = {"m": [(0, 0), (14, 0)], "n": [(14.6, 0), (30, 0)]}
    assert names(run([(0, 0), (30, 0)], gap, snap=0.8)) == ["m", "n"] and names(run([(0, 0), (30, 0)], gap, snap=0.2)) != ["m", "n"]
    assert names(run([(0, 0), (6, 0), (13, 0)], {"m": [(0, 0), (13, 0)], "next": [(13, 0), (29, 0)]})) == ["m"]
    assert run(STREET[::-1], CUT) is None
    assert names(run([(10, 11), (10, 24)], CUT)) == ["q"]


@pytest.mark.parametrize("shift", [1.5, 5, 9])
def test_lateral_shift_is_the_drift(shift):
    r = go([(x + 0.3 - shift, y) for x, y in STREET], CUT)
    assert names(r) == ["p", "q", "r"] and r["dtw_distance"] == pytest.approx(shift, abs=0.5)


def test_curve():
    ring = lambda r, a, b, n: [(r * math.cos(a + (b - a) * k / (n - 1)), r * math.sin(a + (b - a) * k / (n - 1))) for k in range(n)]
    b = {k: ring(55.5, 0.7 * k, 0.7 * k + 0.7, 6) for k in range(4)}
    assert names(go(ring(55, 0.0, 2.8, 25), b)) == [0, 1, 2, 3]


def test_overlap_part():
    """A third of A beside B, and A that ends with B."""
    a, b = [(0, 0), (0, 90)], {"m": [(0.3, 30), (0.3, 45)], "n": [(0.3, 45), (0.3, 60)]}
    part = go(a, b, step=10)["overlap_pct"]
    assert 33 <= part <= 56 and go(a, b, step=10, emission="segment", bearing_weight=2.0)["overlap_pct"] == 33
    assert go([(0, 30), (0, 60)], b, step=10)["overlap_pct"] == 100


def test_segments():
    r = go(STREET, CUT, emission="segment")
    assert names(r) == ["p", "q", "r"]
    assert (r["dtw_distance"], r["max_dtw_distance"], r["min_dtw_distance"]) == pytest.approx((0.3, 0.3, 0.3))


def test_step_weights():
    a, b = [(0, y) for y in range(0, 44, 4)], {"m": [(0.4, 0), (0.4, 15)]}
    assert go(a, b, step=30, beta=4.0)["cost"] > go(a, b, step=30, beta=1.0)["cost"]
    assert go(STREET, CUT, alpha=0.4)["cost"] <= go(STREET, CUT)["cost"]


def test_costs_equal_brute_force():
    """Against plain Dijkstra over (A-point, vertex) states."""
    import heapq

    from roadweave.functions.route import one_problem

    draw = np.random.default_rng(3)
    for _ in range(40):
        a = np.cumsum(draw.uniform(-2, 9, (4, 2)), axis=0)
        b = [(k, np.cumsum(draw.uniform(-2, 9, (3, 2)), axis=0) + draw.uniform(-3, 3, 2)) for k in range(3)]
        alpha, beta = float(draw.uniform(0.3, 1)), float(draw.uniform(1, 4))
        r = match_route(a, b, snap=4.0, step=5, alpha=alpha, beta=beta)
        g = one_problem(a, b, 4.0, 5)[1]
        p, xy = g.a.xy, g.b.xy
        e = np.hypot(p[:, None, 0] - xy[None, :, 0], p[:, None, 1] - xy[None, :, 1])
        after = [[] for _ in xy]
        for u, v in g.arcs.tolist():
            after[u].append(v)
        best = {(0, v): e[0, v] for v in range(len(xy))}
        heap = [(c, k) for k, c in best.items()]
        heapq.heapify(heap)
        while heap:
            c, (i, v) = heapq.heappop(heap)
            if c > best[i, v]:
                continue
            ways = [((i, w), alpha * e[i, w]) for w in after[v]]
            if i + 1 < len(p):
                ways += [((i + 1, v), beta * e[i + 1, v])] + [((i + 1, w), e[i + 1, w]) for w in after[v]]
            for k, d in ways:
                if c + d < best.get(k, np.inf):
                    best[k] = c + d
                    heapq.heappush(heap, (c + d, k))
        want = min(best[len(p) - 1, v] for v in range(len(xy)))
        assert r is None or r["cost"] == pytest.approx(want)


def test_tables(spark):
    a = lines(spark, {1: STREET, 2: [(910, 0), (910, 40)], 3: STREET[::-1], 4: [(10, -4), (10, 7)]})
    b = lines(spark, {11: CUT["p"], 12: CUT["q"], 13: CUT["r"]})
    long, summary = routes.match_routes(a, b, snap=0.5, step=2)
    assert long.columns == list(routes.LONG) and summary.columns == list(routes.SUMMARY)
    s = {r.source_id: r for r in summary.collect()}
    assert s[1].dest_ids == [11, 12, 13] and s[1].match_type == "1:N_ROUTE" and s[2].match_type == s[3].match_type == "NO_MATCH"
    assert s[4].dest_ids == [11] and s[4].match_type == "1:1"
    rows = sorted((r for r in long.collect() if r.source_id == 1), key=lambda r: r.seq)
    assert [(r.dest_id, r.edge_b_used_pct) for r in rows] == [(11, 100.0), (12, 100.0), (13, 100.0)]
    none, gone = routes.resolve_routes(summary, long, max_match_dist=0.1)
    assert {r.match_type for r in none.collect()} == {"NO_MATCH"} and gone.count() == 0
    same, kept = routes.resolve_routes(summary, long, max_match_dist=5.0, min_overlap_pct=50)
    assert kept.count() == 4 and {r.source_id for r in same.collect() if r.dest_ids} == {1, 4}
    report = routes.validation_report(summary, long).first()
    assert (report.matched, report.no_match, report.contested, report.covered_below_95) == (2, 2, 1, 0) and report.median_usage == 100
    assert [r.source_id for r in routes.worst(summary, k=1, largest=False).collect()] == [min(s.values(), key=lambda r: r.dtw_distance or 1e9).source_id]


def test_sweep(spark):
    from roadweave.operators.perturb import first_change

    a, b = lines(spark, {1: STREET, 2: [(10, 8), (10, 27)]}), lines(spark, {11: CUT["p"], 12: CUT["q"], 13: CUT["r"]})
    got = routes.swept_routes(a, b, {"shift": [1, 3, 40], "crop": [0.7]}, snap=0.5, step=2)
    rows = {(r.id, r.family, r.magnitude): (r.dest_ids, r.base_ids) for r in got.collect()}
    assert len(rows) == 8 and rows[1, "shift", 1.0] == ([11, 12, 13], [11, 12, 13]) and rows[1, "shift", 40.0] == (None, [11, 12, 13]) and rows[1, "crop", 0.7] == ([12], [11, 12, 13])
    first = {(r.id, r.family): (r.changed_at, r.lost_at) for r in first_change(got).collect()}
    assert first[1, "shift"] == (40.0, 40.0) and first[1, "crop"] == (0.7, None)


def test_debug_tables():
    r = go(STREET, CUT, debug=True)
    assert r["debug"]["final_cost"] == r["cost"] and r["debug"]["D"].shape[0] == len(r["debug"]["places"]) and names(r) == names(go(STREET, CUT))
    assert go(STREET[::-1], CUT, debug=True)["reason"] == "B is touched, never walked" and "no length" in go([(0, 0)], CUT, debug=True)["reason"]
