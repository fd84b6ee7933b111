import itertools
import random

import pytest

from roadweave.functions import dag
from roadweave.operators import dag as op

from .conftest import lines


def brute(a, b, radius, alpha, beta):
    """Cheapest valid relation among all choices of a simple run for each source vertex."""
    cost = dag.candidates(a, b, radius)
    runs = []
    for c in cost:
        own, stack = set(), [(v,) for v in c]
        while stack:
            r = stack.pop()
            own.add(frozenset(r))
            stack += [(*r, w) for w in b.after[r[-1]] if w in c and w not in r]
        runs.append(sorted(own, key=sorted))
    best = float("inf")
    for pick in itertools.product(*runs):
        pairs = {(u, v) for u, r in enumerate(pick) for v in r}
        c = dag.cost_of(pairs, a, b, cost, alpha, beta)
        if c < best - 1e-9 and not any(dag.broken_rules(pairs, a, b)):
            best = c
    return best


SHAPES = {
    "chain": ({0: (0, 0), 1: (10, 0), 2: (20, 0)}, [(0, 1), (1, 2)]),
    "split": ({0: (0, 0), 1: (10, 0), 2: (20, 6), 3: (20, -6)}, [(0, 1), (1, 2), (1, 3)]),
    "merge": ({0: (0, 6), 1: (0, -6), 2: (10, 0), 3: (20, 0)}, [(0, 2), (1, 2), (2, 3)]),
    "diamond": ({0: (0, 0), 1: (4, 0), 2: (8, 3), 3: (8, -3), 4: (12, 0)}, [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4)]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_brute_force(shape):
    places, arcs = SHAPES[shape]
    a, _ = dag.net(places, arcs)
    draw = random.Random(shape)
    for _ in range(6):
        moved = {k: (x + draw.uniform(-1.5, 1.5), y + 0.5 + draw.uniform(-1.5, 1.5)) for k, (x, y) in places.items()}
        b, _ = dag.net(moved, arcs)
        radius = 7.0 if shape == "diamond" else 12.0
        for alpha, beta in ((1.0, 1.0), (0.5, 1.5), (1.0, 4.0)):
            want = brute(a, b, radius, alpha, beta)
            try:
                got, pairs = dag.match(a, b, radius, alpha, beta)
            except ValueError:
                assert want == float("inf")
                continue
            assert not any(dag.broken_rules(pairs, a, b))
            assert got == pytest.approx(dag.cost_of(pairs, a, b, dag.candidates(a, b, radius), alpha, beta))
            assert got == pytest.approx(want)


def test_stalls_follow_their_price():
    """A chain along a street that begins later: free stalls gather at its start, dear ones spread out; costs as by brute force."""
    n = 5
    a, _ = dag.net({k: (3.0 * k, 0) for k in range(n)}, [(k, k + 1) for k in range(n - 1)])
    b, _ = dag.net({k: (3.0 * k + 6.5, 1.0) for k in range(n)}, [(k, k + 1) for k in range(n - 1)])
    stalls = []
    for beta in (1.0, 2.0, 9.0):
        cost, pairs = dag.match(a, b, 14, 1, beta)
        assert cost == pytest.approx(brute(a, b, 14, 1, beta))
        stalls.append(n - len({v for _, v in pairs}))
    assert stalls[0] > 0 == stalls[-1] and stalls == sorted(stalls, reverse=True)


def test_private_exits_are_refused():
    """Each way out of a fork has a street of its own, and the streets don't meet."""
    a, _ = dag.net({"fork": (1, 3), "left": (4, 7), "right": (8, 3)}, [("fork", "left"), ("fork", "right")])
    b, _ = dag.net({0: (0.4, 3.6), 1: (3.5, 7.5), 2: (1.5, 2.2), 3: (8, 2.2)}, [(0, 1), (2, 3)])
    assert brute(a, b, 1.3, 1.0, 1.0) == float("inf")
    with pytest.raises(dag.NoMatching, match="no valid matching"):
        dag.match(a, b, 1.3)


def test_cycle_and_size():
    a, _ = dag.net({0: (0, 0), 1: (1, 0)}, [(0, 1), (1, 0)])
    with pytest.raises(dag.NotADag):
        dag.match(a, a, 6)
    n = 40  # a chain of diamonds stays narrow
    places, arcs = {("m", 0): (0, 0)}, []
    for k in range(n):
        places |= {("u", k): (8 * k + 4, 3), ("d", k): (8 * k + 4, -3), ("m", k + 1): (8 * k + 8, 0)}
        arcs += [(("m", k), ("u", k)), (("m", k), ("d", k)), (("u", k), ("m", k + 1)), (("d", k), ("m", k + 1))]
    x, _ = dag.net(places, arcs)
    y, _ = dag.net({k: (p[0], p[1] + 0.4) for k, p in places.items()}, arcs)
    cost, pairs = dag.match(x, y, 6)
    assert cost == pytest.approx(0.4 * len(places)) and len(pairs) == len(places)
    with pytest.raises(dag.TooSlow):
        dag.match(x, y, 6, max_seconds=0.0)


@pytest.mark.parametrize("shape", SHAPES)
def test_bounded_rows_change_nothing(shape):
    places, arcs = SHAPES[shape]
    a, _ = dag.net(places, arcs)
    b, _ = dag.net({k: (x + 0.7, y - 0.3) for k, (x, y) in places.items()}, arcs)
    whole = dag.match(a, b, 9.0, 0.7, 1.4)
    for most in (1, 4, 12):
        cost, pairs = dag.match(a, b, 9.0, 0.7, 1.4, most_rows=most)
        assert cost == pytest.approx(whole[0]) and not any(dag.broken_rules(pairs, a, b))


def tables(spark, a, b, **more):
    got = op.match_dag(lines(spark, a), lines(spark, b), **{"max_distance": 10.0, "step": 5.0, "bearing_weight": 2.0, **more})
    return {k: v.collect() for k, v in got.items()}


def test_parts(spark):
    t = tables(spark, {"a": [(5, 5), (5, 65)]}, {"b1": [(8, 5), (8, 35)], "b2": [(8, 35), (8, 65)]})
    p = sorted(t["parts"], key=lambda r: r.part)
    assert [(r.dest_id, r.part_type, r.n_a_arcs, r.a_from_m, r.a_to_m) for r in p] == [("b1", "match", 6, 0, 30), ("b2", "match", 6, 30, 60)]
    assert sum(r.a_pct for r in p) == pytest.approx(100) and all(abs(r.drift_m - 3) < 0.5 for r in p)
    assert [(r.source_id, r.dest_ids, r.n_parts, r.match_type) for r in t["summary"]] == [("a", "b1;b2", 2, "1:N_ROUTE")]
    t = tables(spark, {"a": [(0, -15), (0, 75)]}, {"b": [(3, 0), (3, 60)]}, max_distance=20.0)
    p = sorted(t["parts"], key=lambda r: r.part)
    assert [r.part_type for r in p] == ["head", "match", "tail"] and sum(r.a_len_m for r in p) == pytest.approx(90)
    assert t["summary"][0].a_head_m == pytest.approx(15, abs=5) and t["summary"][0].a_tail_m == pytest.approx(15, abs=5)
    t = tables(spark, {"a": [(0, 20), (0, 50)]}, {"b": [(3, 0), (3, 60)]})
    assert len(t["parts"]) == 1 and t["parts"][0].b_head_m == pytest.approx(20, abs=2.5)


def plain_parts(rows):
    """The same stretches, walked through one by one, from rows (a_seq, place, dest, b_seq, a_from, a_to)."""
    rows = sorted(rows)
    cells = [r[2:4] for r in rows]
    kind = ["match"] * len(rows)
    if len(set(cells)) > 1:
        lead = next(k for k, c in enumerate(cells) if c != cells[0])
        trail = len(rows) - next(k for k, c in enumerate(reversed(cells)) if c != cells[-1])
        for k in range(len(rows)):
            if k < lead and rows[k][0] != rows[lead - 1][0]:
                kind[k] = "head"
            elif k >= trail and rows[k][0] != rows[trail][0]:
                kind[k] = "tail"
    out, cursor = [], rows[0][4]
    for (k, dest), group in itertools.groupby(zip(kind, rows, strict=True), lambda x: (x[0], x[1][2])):
        group = [r for _, r in group]
        to = max([cursor, *(r[5] for r in group)])
        out.append((len(out) + 1, k, dest, cursor, to, len(group), len({r[0] for r in group}), len({r[3] for r in group})))
        cursor = to
    return out


def test_stretches_equal_a_walk(spark):
    draw = random.Random(5)
    rows, want = [], {}
    for road in range(60):
        own, dest, seq = [], draw.randint(0, 3), draw.randint(0, 5)
        for a_seq in range(draw.randint(1, 9)):
            for place in range(draw.choice([1, 1, 1, 2, 3])):
                if place or draw.random() < 0.4:
                    seq += 1
                    if draw.random() < 0.4:
                        dest, seq = draw.randint(0, 3), draw.randint(0, 5)
                own.append((a_seq, place, dest, seq, 5.0 * a_seq, 5.0 * a_seq + 5.0))
        rows += [(road, d, a, p, s, 1.0, 2.0, f, t, 45.0, 5.0 * s, 5.0 * s + 5, 60.0) for a, p, d, s, f, t in own]
        want[road] = plain_parts(own)
    df = spark.createDataFrame(rows, op.PAIR.format(a="long", b="long")).repartition(3)
    got = {k: sorted((r.part, r.part_type, r.dest_id, r.a_from_m, r.a_to_m, r.n_pairs, r.n_a_arcs, r.n_b_arcs) for r in g) for k, g in itertools.groupby(sorted(op.stretches(df).collect(), key=lambda r: r.source_id), lambda r: r.source_id)}
    assert got == want and any(k[1] == "head" for v in want.values() for k in v)


def test_rules_as_joins(spark):
    draw = random.Random(11)
    found = set()
    for shape, (places, arcs) in SHAPES.items():
        a, _ = dag.net(places, arcs)
        for _ in range(3):
            pairs = {(u, v) for u in range(len(places)) for v in range(len(places)) if draw.random() < 0.4} or {(0, 0)}
            want = {(u, v, rule) for rule, bad in zip(("step_back", "unfed", "stuck"), dag.broken_rules(pairs, a, a), strict=True) for u, v in bad}
            steps = spark.createDataFrame([(u, v) for u, vs in enumerate(a.after) for v in vs], "tail long, head long")
            got = op.check_rules(spark.createDataFrame(sorted(pairs), "u long, v long"), steps, steps)
            assert {tuple(r) for r in got.collect()} == want, shape
            found |= {r for *_, r in want}
    assert found == {"step_back", "unfed", "stuck"}


def test_network(spark):
    """A street that forks around a block and joins again, drawn with other cuts on the other side; exact targets."""
    a = {"in": [(0, 0), (0, 40)], "west1": [(0, 40), (-18, 70)], "west2": [(-18, 70), (0, 100)], "east1": [(0, 40), (18, 70)], "east2": [(18, 70), (0, 100)], "out": [(0, 100), (0, 140)], "lone": [(700, 0), (700, 9)]}
    b = {1: [(2, 0), (2, 40)], 2: [(2, 40), (-16, 70), (2, 100)], 3: [(2, 40), (20, 70), (2, 100)], 4: [(2, 100), (2, 140)]}
    t = tables(spark, a, b, max_distance=12.0, alpha=0.8, beta=1.2)
    assert {r.source_id: r.dest_ids for r in t["summary"]} == {"in": "1", "west1": "2", "west2": "2", "east1": "3", "east2": "3", "out": "4"}
    assert all(r.avg_dist_m < 4 for r in t["summary"])
    assert [r.sources for r in t["errors"]] == [["lone"]] and [len(r.sources) for r in t["costs"]] == [6]


# ---------------------------------------------------------------- engines


def drawn(draw, n):
    """A random acyclic network near a line, and a target that looks like it, with some arcs more or fewer."""
    places = {k: (6.0 * k + draw.uniform(-2, 2), draw.uniform(-8, 8)) for k in range(n)}
    arcs = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 4)) if draw.random() < 0.45]
    moved = {k: (x + draw.uniform(-1, 1), y + draw.uniform(-1, 1)) for k, (x, y) in places.items()}
    more = [*arcs, *((i, j) for i in range(n) for j in range(i + 1, min(n, i + 4)) if draw.random() < 0.3)]
    return dag.net(places, arcs)[0], dag.net(moved, more)[0]


def test_engines_agree_on_random_networks():
    draw, matched = random.Random(21), 0
    for k in range(120):
        a, b = drawn(draw, draw.randint(2, 9))
        alpha, beta = draw.choice([(1.0, 1.0), (0.5, 1.5), (1.0, 4.0), (0.7, 0.6)])
        got = []
        for engine in ("profiles", "elimination"):
            try:
                cost, runs = dag.match_runs(a, b, 14.0, alpha, beta, engine=engine)
            except dag.NoMatching:
                got.append(None)
                continue
            got.append(cost)
            pairs = {(u, v) for u, run in enumerate(runs) for v in run}
            assert not any(dag.broken_rules(pairs, a, b))
            if beta >= 1:
                assert cost == pytest.approx(dag.cost_of(pairs, a, b, dag.candidates(a, b, 14.0), alpha, beta))
        assert got[0] == (None if got[1] is None else pytest.approx(got[1])), k
        matched += got[0] is not None
    assert matched > 40


def test_a_narrow_beam_changes_nothing():
    from roadweave.functions import profile

    draw, cut = random.Random(5), 0
    for _ in range(60):
        a, b = drawn(draw, 10)
        cost = dag.candidates(a, b, 16.0)
        steps = profile.prepare(a.before, a.after, cost, lambda v, y: dag.runs_from(y, cost[v], b, 1.0)[0], b.before, 1.5)  # noqa: B023
        wide, _, most = profile.solve(steps, a.after, beam=10**9)
        narrow, ends, kept = profile.solve(steps, a.after, beam=2)
        assert narrow == pytest.approx(wide) or narrow == wide
        assert most <= profile.predicted_rows(a.before, a.after, [len(c) for c in cost])
        cut += kept < most
    assert cut > 5  # the bounds rule profiles out


def test_plan_bounds_what_is_held():
    draw = random.Random(8)
    for _ in range(40):
        a, b = drawn(draw, 8)
        cost = dag.candidates(a, b, 14.0)
        p = dag.plan(a, cost)
        try:
            want = dag.match_runs(a, b, 14.0, engine="elimination")[0]
        except dag.NoMatching:
            continue
        assert p["engine"] == ("elimination" if dag.small_forest(a, [len(c) for c in cost]) else "profiles") and p["vertices"] == 8
        assert dag.match_runs(a, b, 14.0, engine="elimination", most_rows=int(p["elimination_rows"]))[0] == pytest.approx(want)
        assert dag.match_runs(a, b, 14.0, engine="profiles", most_rows=int(p["profile_rows"]))[0] == pytest.approx(want)
    many = dag.net({k: (float(k), 0.0) for k in range(41)}, [(k, 40) for k in range(40)])[0]  # forty ways into one place
    assert dag.plan(many, [dict.fromkeys(range(4), 1.0)] * 41)["profile_rows"] == 4.0**41


def test_city_blocks():
    """A grid of streets, drawn anew; elimination can't hold it."""
    draw = random.Random(3)
    places = {(i, j): (10.0 * i, 10.0 * j) for i in range(8) for j in range(8)}
    arcs = [((i, j), (i + 1, j)) for i in range(7) for j in range(8)] + [((i, j), (i, j + 1)) for i in range(8) for j in range(7)]
    a, _ = dag.net(places, arcs)
    b, _ = dag.net({k: (x + draw.uniform(-2, 2), y + draw.uniform(-2, 2)) for k, (x, y) in places.items()}, arcs)
    cost, pairs = dag.match(a, b, 12.0, max_seconds=30)
    assert len(pairs) >= 64 and not any(dag.broken_rules(pairs, a, b)) and cost <= sum(c[k] for k, c in enumerate(dag.candidates(a, b, 12.0))) + 1e-9
    assert cost == pytest.approx(dag.cost_of(pairs, a, b, dag.candidates(a, b, 12.0), 1.0, 1.0))
    with pytest.raises((dag.TooSlow, dag.TooLarge)):
        dag.match_runs(a, b, 12.0, most_rows=100_000, max_seconds=2.0, engine="elimination")


def test_plans_of_components(spark):
    a = {"in": [(0, 0), (0, 40)], "west": [(0, 40), (-18, 70), (0, 100)], "east": [(0, 40), (18, 70), (0, 100)], "out": [(0, 100), (0, 120)], "lone": [(900, 0), (900, 50)], "round": [(2000, 0), (2040, 0), (2040, 40), (2000, 0)]}
    b = {1: [(2, 0), (2, 40)], 2: [(2, 40), (-16, 70), (2, 100)], 3: [(2, 40), (20, 70), (2, 100)], 4: [(2000, 1), (2040, 1)]}
    rows = {r.n_edges: r for r in op.plan_dag(lines(spark, a), lines(spark, b), max_distance=12.0).where("engine is not null").collect()}
    assert set(rows) == {4} and rows[4].engine == "profiles" and rows[4].vertices > 20 and rows[4].profile_rows >= 1 and rows[4].elimination_rows >= 1
    assert op.plan_dag(lines(spark, a), lines(spark, b), max_distance=12.0).count() == 3


def test_nearest_targets_at_any_distance(spark):
    """A source far from all, and one without any."""
    a = {"near": [(0, 0), (0, 40)], "far": [(3000, 0), (3000, 30)]}
    b = {1: [(2, 0), (2, 40)], 2: [(2400, 0), (2400, 30)], 3: [(5000, 0), (5000, 30)]}
    plain = tables(spark, a, b)
    assert [s for r in plain["errors"] for s in r.sources].count("far") == 1
    t = tables(spark, a, b, any_distance=True)
    assert not t["errors"] and {r.source_id: r.dest_ids for r in t["summary"]} == {"near": "1", "far": "2"}
    every = dag.segment_net(sorted(b.items()), 5.0)
    for name, line in a.items():
        want = dag.match_runs(dag.segment_net([(name, line)], 5.0), every, 10.0, weight=2.0)[0]
        assert next(r.cost for r in t["costs"] if r.sources == [name]) == pytest.approx(want)
    assert [r.sources for r in tables(spark, {"x": [(0, 0), (9, 0)]}, {}, any_distance=True)["errors"]] == [["x"]]
