"""Lattices of routes and the choice among them, against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from roadweave.functions import route
from roadweave.operators import reconcile, routes

from .conftest import lines

# ---------------------------------------------------------------- intervals, stubs, twins, bearing gate

STREET = {1: [(0, 0), (100, 0)]}
CHAIN = {11: [(-3, 1), (30, 1)], 12: [(30, 1), (55, 1), (60, 1)], 13: [(60, 1), (96, 1)], 14: [(96, 1), (130, 1)]}


def test_members_say_which_part_of_an_edge_they_use(spark):
    long, summary = routes.match_routes(lines(spark, STREET), lines(spark, CHAIN), step=5.0)
    rows = sorted(long.collect(), key=lambda r: r.seq)
    assert [r.dest_id for r in rows] == [11, 12, 13, 14]
    spans = [(r.edge_b_from_m, r.edge_b_to_m, r.edge_b_len) for r in rows]
    assert spans[0][0] == pytest.approx(3) and spans[0][1] == pytest.approx(33) and spans[3][0] == 0 and spans[3][1] == pytest.approx(4)
    assert all(a == 0 and b == pytest.approx(size) for a, b, size in spans[1:3])
    assert all(b - a == pytest.approx(r.edge_matched_len) for (a, b, _), r in zip(spans, rows, strict=True))
    s, cost = summary.first(), routes.route_costs(lines(spark, STREET), lines(spark, CHAIN), step=5.0).first()
    assert s.dp_cost == pytest.approx(cost.cost) and s.dp_cost > s.dtw_distance


def test_stubs_go_only_at_the_ends(spark):
    got = lambda **more: [r.dest_id for r in routes.match_routes(lines(spark, STREET), lines(spark, CHAIN), step=5.0, **more)[0].orderBy("seq").collect()]
    assert got(stub_pct=12.0, stub_m=10.0) == [11, 12, 13] and got(stub_pct=12.0, stub_m=3.0) == [11, 12, 13, 14]
    assert got(stub_pct=90.0, stub_m=35.0)[-1] != 14
    short = {11: [(0, 1), (50, 1)], 12: [(50, 1), (51, 1)], 13: [(51, 1), (100, 1)]}
    assert [r.dest_id for r in routes.match_routes(lines(spark, STREET), lines(spark, short), step=5.0, stub_pct=100.1, stub_m=10.0)[0].orderBy("seq").collect()] == [11, 12, 13]


def test_no_route_turns_back_onto_a_twin(spark):
    a = {1: [(0, 0), (40, 0), (40, 0.5), (2, 0.5)]}
    b = {11: [(0, 0.2), (40, 0.2)], 12: [(40, 0.2), (0, 0.2)]}
    free = routes.match_routes(lines(spark, a), lines(spark, b), step=5.0)[1].first()
    assert free.dest_ids == [11, 12]
    twinned = routes.with_twins(lines(spark, b))
    assert {(r.id, r.twin) for r in twinned.collect()} == {(11, 12), (12, 11)}
    held = routes.match_routes(lines(spark, a), twinned, step=5.0)[1].first()
    assert len(held.dest_ids) == 1 and held.dp_cost > free.dp_cost
    both = routes.with_twins(lines(spark, {**b, 13: [(0, 0.2), (20, 9), (40, 0.2)], 14: [(40, 0.2), (20, 9), (0, 0.2)], 15: [(0, 0), (9, 9)]}))  # parallel roads have twins of their own
    assert {(r.id, r.twin) for r in both.collect()} == {(11, 12), (12, 11), (13, 14), (14, 13), (15, None)}


def test_bearing_gate(spark):
    a, b = lines(spark, STREET), lines(spark, {**CHAIN, 20: [(50, -20), (50, 20)], 21: [(96, 1), (60, 1)], 22: [(50, 0), (55, 5), (50, 0)]})
    near = lambda limit: {e["id_b"] for e in routes.near_edges(a, b, routes.RouteParameters(max_turn=limit)).first().near}
    assert near(None) == {11, 12, 13, 14, 20, 21, 22} and near(45.0) == {11, 12, 13, 14, 22} and near(90.0) == {11, 12, 13, 14, 20, 22}


def test_sources_do_not_depend_on_their_batch():
    draw = np.random.default_rng(2)
    a = [np.cumsum(draw.uniform(-2, 9, (draw.integers(2, 6), 2)), axis=0) for _ in range(60)]
    b = [[(k, np.cumsum(draw.uniform(-2, 9, (3, 2)), axis=0) + draw.uniform(-3, 3, 2)) for k in range(draw.integers(1, 5))] for _ in a]
    size_a, per = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flat = [p for edges in b for _, p in edges]
    for e in (route.Emission(), route.Emission(True, 0.2)):
        q = route.problem(np.concatenate(a), route.bounds_of(size_a), np.concatenate(flat), route.bounds_of(np.array([len(p) for p in flat])), route.bounds_of(per), 4.0, 3.0, route.gap_of(None, 3.0, e))
        w = route.ways(q, e)
        whole = dict(zip(w.source.tolist(), w.cost.tolist(), strict=True))
        for k in range(len(a)):
            ids, one = route.one_problem(a[k], b[k], 4.0, 3.0, route.gap_of(None, 3.0, e))
            alone = route.ways(one, e).cost.tolist()
            assert alone == ([whole[k]] if k in whole else [])


# ---------------------------------------------------------------- lattice


def all_routes(q):
    """{edges of a way: least cost} of every walk over (row, place), by exhausting states with their sequences of edges."""
    p, xy, owner = q.a.xy, q.b.xy, q.owner.tolist()
    e = np.hypot(p[:, None, 0] - xy[None, :, 0], p[:, None, 1] - xy[None, :, 1])
    after = [[] for _ in xy]
    for u, v in q.arcs.tolist():
        after[u].append(v)
    best, todo = {}, [((0, v, (owner[v],), (owner[v], v)), e[0, v]) for v in range(len(xy))]
    while todo:
        (i, v, seq, entry), c = todo.pop()
        key = (i, v, seq, entry[0])
        if c >= best.get(key, np.inf) - 1e-12 or len(seq) > 5:
            continue
        best[key] = c
        todo += [((i, w, seq + (owner[w],) * (owner[w] != owner[v]), entry), c + e[i, w]) for w in after[v]]
        if i + 1 < len(p):
            todo += [((i + 1, w, seq + (owner[w],) * (owner[w] != owner[v]), entry), c + e[i + 1, w]) for w in [v, *after[v]]]
    out = {}
    for (i, v, seq, first), c in best.items():
        if i == len(p) - 1:
            out[first, owner[v]] = min(out.get((first, owner[v]), np.inf), c)
    return out


def test_lattice_has_the_least_cost_of_every_pair_of_ends():
    draw = np.random.default_rng(8)
    for _ in range(25):
        a = np.cumsum(draw.uniform(0, 9, (3, 2)), axis=0)
        corner = [draw.uniform(-2, 18, 2) for _ in range(4)]
        b = [(k, np.array([corner[i], corner[j]])) for k, (i, j) in enumerate(draw.permutation([(i, j) for i in range(4) for j in range(4) if i != j])[:4])]
        ids, q = route.one_problem(a, b, 0.5, 6.0)
        w = route.ways(q, route.Emission(), each_entry=True)
        got = {(int(s), int(q.owner[w.state[w.bounds[k + 1] - 1]])): c for k, (s, c) in enumerate(zip(w.entry, w.cost, strict=True))}
        want = all_routes(q)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
        assert route.ways(q, route.Emission()).cost[0] == pytest.approx(min(want.values()))


def test_lattice_begins_with_the_route(spark):
    draw = np.random.default_rng(3)
    a, b = {}, {}
    for k in range(20):
        x = 1000.0 * k
        a[k] = [(x, 0), (x + 50, draw.uniform(-5, 5)), (x + 100, 0)]
        for j, (p, r) in enumerate([((0, 0), (50, 8)), ((0, 0), (50, -8)), ((50, 8), (100, 0)), ((50, -8), (100, 0)), ((50, 8), (50, -8)), ((100, 0), (120, 3))]):
            b[10 * k + j] = [(x + p[0] + 0.3, p[1] + draw.uniform(-0.2, 0.2)), (x + r[0] + 0.3, r[1] + draw.uniform(-0.2, 0.2))]
    long, summary = routes.match_routes(lines(spark, a), lines(spark, b), step=8.0)
    alts = routes.route_lattice(lines(spark, a), lines(spark, b), k_max=5, step=8.0).collect()
    first = {r.source_id: r for r in alts if r["rank"] == 0}
    own = {r.source_id: r for r in summary.collect()}
    spans = {(r.source_id, r.seq): (r.dest_id, r.edge_b_from_m, r.edge_b_to_m) for r in long.collect()}
    for s, r in own.items():
        assert first[s].dest_ids == r.dest_ids and first[s].dp_cost == r.dp_cost and first[s].drift_m == r.dtw_distance and first[s].overlap_pct == r.overlap_pct
        assert [(c.dest_id, c.from_m, c.to_m) for c in first[s].claims] == [spans[s, c.seq] for c in first[s].claims]
    for s in own:
        mine = sorted((r for r in alts if r.source_id == s), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine))) and 2 <= len(mine) <= 5 and len({tuple(r.dest_ids) for r in mine}) == len(mine)
        assert all(x.dp_cost <= y.dp_cost for x, y in itertools.pairwise(mine))


# ---------------------------------------------------------------- choice

LATTICE = "source_id long, rank int, dp_cost double, drift_m double, overlap_pct long, bearing_diff double, a_len double, dest_ids array<long>, claims array<struct<dest_id:long,seq:int,from_m:double,to_m:double>>"


def drawn(draw, sources, edges, most=4):
    """Candidates as plain rows: (source, rank, drift, overlap, a_len, claims)."""
    rows = []
    for s in range(sources):
        size = draw.choice([10.0, 20.0, 35.5])
        for k in range(draw.randint(1, most)):
            claims = []
            for seq in range(draw.randint(1, 2)):
                a, b = sorted(draw.sample([0.0, 5.0, 7.5, 12.0, 20.0, 31.25], 2))
                claims.append((draw.randrange(edges), seq, a, b))
            rows.append((s, k, draw.choice([1.0, 2.5, 6.0, 11.0, 15.0]), draw.choice([40, 80, 100]), size, claims))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(s, k, 0.0, d, o, 0.0, size, [c[0] for c in claims], claims) for s, k, d, o, size, claims in rows], LATTICE)


def least(rows, tau, mu):
    """The least sum by trying everything."""
    options = {}
    for s, k, d, o, size, claims in rows:
        options.setdefault(s, [(size * tau, -1, [])]).append((size * (o / 100 * d + (1 - o / 100) * tau), k, claims))

    def cost(picks):
        ends = {}
        for _, _, claims in picks:
            for b, _, f, t in claims:
                ends.setdefault(b, set()).update((f, t))
        double = 0.0
        for b, at in ends.items():
            for lo, hi in itertools.pairwise(sorted(at)):
                double += (hi - lo) * max(0, sum(any(c[0] == b and c[2] <= lo and c[3] >= hi for c in claims) for _, _, claims in picks) - 1)
        return sum(c for c, _, _ in picks) + mu * double

    return min(map(cost, itertools.product(*options.values()))), cost, options


@pytest.mark.parametrize("mu", [0.0, 0.6, 3.0, 50.0])
def test_choice_is_the_cheapest(spark, mu):
    draw, tau = random.Random(int(mu * 10) + 1), 10.0
    rows, pieces = [], []
    for n in range(4):  # separate parts of the network, solved in one run
        part = drawn(draw, 5, 3)
        pieces.append([(s + 10 * n, k, d, o, size, [(b + 10 * n, q, f, t) for b, q, f, t in claims]) for s, k, d, o, size, claims in part])
        rows += pieces[-1]
    for pruned in (True, False):
        choices, paid = reconcile.choose(frame(spark, rows), tau, mu, pruned=pruned)
        got = {r.source_id: r for r in choices.collect()}
        assert len(got) == len({r[0] for r in rows}) and all(r.exact for r in got.values())
        for part in pieces:
            want, cost, options = least(part, tau, mu)
            mine = [next(o for o in options[s] if o[1] == got[s]["rank"]) for s in options]
            assert cost(mine) == pytest.approx(want)
        assert sum(r.cost for r in got.values()) + sum(r.paid for r in paid.collect()) == pytest.approx(sum(least(p, tau, mu)[0] for p in pieces))


def test_large_components_are_split():
    draw = random.Random(6)
    for _ in range(30):
        rows = drawn(draw, 7, 2)
        want, cost, options = least(rows, 10.0, 2.0)
        ends = {}
        for r in rows:
            for b, _, f, t in r[5]:
                ends.setdefault(b, set()).update((f, t))
        atoms = [(b, lo, hi) for b, at in ends.items() for lo, hi in itertools.pairwise(sorted(at))]
        used = lambda claims: [{"atom": f"{b}/{lo}", "width": hi - lo, "used": 0} for b, lo, hi in atoms if any(c[0] == b and c[2] <= lo and c[3] >= hi for c in claims)]
        table = pd.DataFrame([{"source_id": s, "rank": k, "cost": c, "atoms": used(claims)} for s, opts in options.items() for c, k, claims in opts])
        pick = lambda got: cost([next(o for o in options[s] if o[1] == k) for s, k in zip(got["source_id"], got["rank"], strict=True)])
        whole, split = reconcile.pack(table, 2.0), reconcile.pack(table, 2.0, most=3)
        assert pick(whole) == pytest.approx(want) and whole["exact"].all() and not split["exact"].any()
        alone = sum(min(o)[0] for o in options.values())
        assert want - 1e-9 <= pick(split) <= cost([min(o, key=lambda x: x[0]) for o in options.values()]) + 1e-9 and alone <= want + 1e-9


def test_probe_counts_what_is_settled(spark):
    far = (1, 0, 1.0, 100, 50.0, [(1, 0, 0.0, 50.0)])  # nothing near it
    poor = (2, 0, 11.0, 20, 50.0, [(2, 0, 0.0, 50.0)])  # hardly better than none, and alone
    rival = [(3, 0, 1.0, 100, 50.0, [(3, 0, 0.0, 50.0)]), (3, 1, 2.0, 100, 50.0, [(4, 0, 0.0, 50.0)]), (4, 0, 1.5, 100, 50.0, [(3, 0, 20.0, 60.0)])]
    rows = [far, poor, *rival]
    got = reconcile.probe(frame(spark, rows), 12.0, 1.0).first()
    assert (got.sources, got.candidates, got.shared_atoms) == (4, 9, 1) and got.shared_m == pytest.approx(30)
    assert got.settled + got.uncoupled + got.active == 4 and got.frozen_pct == pytest.approx(100 * (got.settled + got.uncoupled) / 4)
    choices, paid = reconcile.choose(frame(spark, rows), 12.0, 10.0)
    assert {r.source_id: r["rank"] for r in choices.collect()} == {1: 0, 2: 0, 3: 1, 4: 0} and paid.count() == 0
    cheap, paid = reconcile.choose(frame(spark, rows), 12.0, 0.5)
    assert {r.source_id: r["rank"] for r in cheap.collect()}[3] == 0 and [(r.dest_id, r.lo_m, r.hi_m, r.routes, r.paid) for r in paid.collect()] == [(3, 20.0, 50.0, 2, 15.0)]
    now, issues = reconcile.resolve_network(frame(spark, rows), frame(spark, rows).select("source_id"), 12.0, 10.0)
    assert {(r.source_id, r.dest_id) for r in now.collect()} == {(1, 1), (2, 2), (3, 4), (4, 3)} and {(r.issue, r.about) for r in issues.collect()} == {("reselected", "3")}


def test_choice_of_nothing(spark):
    none = frame(spark, [])
    choices, paid = reconcile.choose(none, 10.0, 1.0)
    assert choices.count() == 0 and paid.count() == 0 and reconcile.probe(none, 10.0, 1.0).first().sources == 0


# ---------------------------------------------------------------- twins


def test_twin_pairs_of_every_kind(spark):
    """Both ways of a road in A; B is complete, one-way, missing a direction's route, or elsewhere."""
    a, b = {}, {}
    for k in range(5):
        y = 1000.0 * k
        a[2 * k], a[2 * k + 1] = [(0, y), (100, y)], [(100, y), (0, y)]
    there = lambda y, dy=0.5: [[(-5, y + dy), (50, y + dy)], [(50, y + dy), (105, y + dy)]]
    for k, ways in {0: "both", 1: "both", 2: "one", 3: "both", 4: "both"}.items():
        for j, line in enumerate(there(1000.0 * k)):
            b[100 * k + 2 * j] = line
            if ways == "both":
                b[100 * k + 2 * j + 1] = line[::-1]
    a[3] = [(100, 1000), (60, 1000)]  # the way back is drawn as a part only
    a[7] = [(100, 3000), (0, 3019)]
    a[9] = [(100, 9000), (0, 9000)]
    sources, edges = lines(spark, a), routes.with_twins(lines(spark, b))
    pairs = spark.createDataFrame([(k, k + 1 if k % 2 == 0 else k - 1) for k in a], "id long, twin long")
    long = routes.match_routes(sources, edges, step=5.0, max_turn=60.0)[0]
    got, proposals = reconcile.twin_consistency(long, pairs, edges)
    rows = {r.source_id: r for r in got.collect()}
    assert {k: r.status for k, r in rows.items()} == {0: "consistent", 2: "partial", 4: "one_way", 6: rows[6].status, 8: "one_sided"} and rows[6].status in ("partial", "consistent")
    assert rows[0].shared_m == pytest.approx(rows[0].own_m) == pytest.approx(100, abs=0.2) and rows[8].twin_m == 0 and 35 < rows[2].shared_m < 45
    repaired = sorted((r.seq, r.dest_id, round(r.from_m, 6), round(r.to_m, 6)) for r in proposals.collect())
    mine = sorted((r.seq, r.dest_id, round(r.edge_b_len - r.edge_b_to_m, 6), round(r.edge_b_len - r.edge_b_from_m, 6)) for r in long.where("source_id = 8").collect())
    assert {r.source_id for r in proposals.collect()} == {9} and [(1 - s, d + 1, f, t) for s, d, f, t in mine[::-1]] == repaired
    elsewhere = long.withColumn("dest_id", routes.F.when(routes.F.col("source_id") == 1, routes.F.col("dest_id") + 300).otherwise(routes.F.col("dest_id")))
    assert {r.source_id: r.status for r in reconcile.twin_consistency(elsewhere, pairs, edges)[0].collect()}[0] == "contradiction"
