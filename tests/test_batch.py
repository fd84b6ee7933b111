"""Components of Mode 3 that are solved together, against dag.py one by one: equal costs and equal pairs, not only equal sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions import batch, dag
from roadweave.functions import geometry as G
from roadweave.operators import dag as op
from roadweave.operators import spatial
from roadweave.operators.components import connected_components
from roadweave.sources import derived

from .conftest import lines


def drawn(draw, n):
    """Streets of the four kinds and straight ones beside chains (with ties), each with a target a little aside."""
    out = []
    for _ in range(n):
        kind, x, y = draw.randrange(5), 100.0 * draw.randrange(40), 60.0 * draw.randrange(500)
        dx, dy = draw.choice([0.0, 0.11, 0.54]), draw.choice([0.0, 0.37, -0.74])
        line = lambda s, dx, dy: (int(s[0]), [(s[1 + k] + x + dx, s[2 + k] + y + dy) for k in (0, 2, 4)])  # noqa: B023, E731
        if kind == 4:
            a, b = [(0, [(x, y), (x + 90, y)])], [(k, [(x + 15.0 * k, y + k * 17 % 11 - 5), (x + 15.0 * k + 15, y + (k + 1) * 17 % 11 - 5)]) for k in range(6)]
        else:
            a, b = [line(s, 0, 0) for s in derived.A_SHAPES[kind]], [line(s, dx, dy) for s in derived.B_SHAPES[kind]]
        out.append((a, b))
    return out


def nets(comps, side, step):
    edges = [c[side] for c in comps]
    flat = [e for c in edges for e in c]
    return batch.nets(np.array([len(c) for c in edges]), np.array([i for i, _ in flat]), np.array([len(p) for _, p in flat]), np.array([p for _, line in flat for p in line], float), step, 3)


@pytest.mark.parametrize(("step", "radius", "alpha", "beta", "least"), [(15.0, 12.0, 1.0, 1.0, 1), (7.0, 14.0, 0.8, 1.2, 1), (15.0, 4.0, 1.0, 1.0, 1), (15.0, 9.0, 1.0, 2.0, 3)])
def test_together_equals_one_by_one(step, radius, alpha, beta, least):
    comps = drawn(random.Random(7), 90)
    a, b = nets(comps, 0, step), nets(comps, 1, step)
    c = batch.candidates(a, b, radius, 0.1, least, look=True)
    s = batch.solve(a, b, c, alpha, beta, 2_000_000)
    low, high, size = batch.spans(a)
    assert np.isfinite(s.cost).sum() > 20 and (np.isfinite(s.cost) | s.none).sum() >= 80
    for k, (own, other) in enumerate(comps):
        x, y = dag.segment_net(own, step), dag.segment_net(other, step)
        f, e = a.first[k], a.first[k + 1]
        assert (x.xy == a.xy[f:e]).all() and x.seq == a.seq[f:e].tolist() and c.farthest[k] == dag.farthest(x, y, least)
        at, sizes = dag.spans(x)
        assert [(*at[u], sizes[x.road[u]]) for u in range(e - f)] == list(zip(low[f:e], high[f:e], size[f:e], strict=True))
        try:
            cost, runs = dag.match_runs(x, y, radius, alpha, beta, 0.1, least)
        except dag.NoMatching:
            assert np.isinf(s.cost[k])
            continue
        assert not s.none[k]
        if np.isfinite(s.cost[k]):
            mine = s.owner == k
            got = list(zip(s.u[mine] - f, s.place[mine], s.v[mine] - b.first[k], strict=True))
            assert s.cost[k] == cost and got == [(u, p, v) for u, run in enumerate(runs) for p, v in enumerate(run)]


def test_equal_streets_are_all_solved_together():
    """Streets with blocks need no work one by one."""
    comps = [c for c in drawn(random.Random(1), 1200) if len(c[0]) == 4]
    a, b = nets(comps, 0, 15.0), nets(comps, 1, 15.0)
    s = batch.solve(a, b, batch.candidates(a, b, 12.0, 0.1, 1), 1.0, 1.0, 2_000_000)
    assert len(comps) > 150 and np.isfinite(s.cost).all()


def test_components_with_and_without_company(spark):
    """Alike, unlike, unmatched and far ones, loops, and one id in two components; in tables, by the operator."""
    a, b = {}, {}
    for k in range(8):
        a |= {f"in{k}": [(0, 500 * k), (40, 500 * k)], f"up{k}": [(40, 500 * k), (80, 500 * k + 14)], f"down{k}": [(40, 500 * k), (80, 500 * k - 14)]}
        if k < 6:
            b |= {f"b{k}": [(0, 500 * k + 1), (41, 500 * k + 1)], f"u{k}": [(41, 500 * k + 1), (80, 500 * k + 15)], f"d{k}": [(41, 500 * k + 1), (80, 500 * k - 13)]}
    a |= {"lone": [(3000, 0), (3040, 10), (3060, 0)], "loop": [(5000, 0), (5040, 0), (5040, 40), (5000, 0)], "split": [(7000, 0), (7030, 0)]}
    b |= {"l": [(3000, 2), (3060, 2)], "o": [(5000, 1), (5040, 1)], "s": [(7000, 1), (7005, 1)], "t": [(7025, 1), (7030, 1)]}
    got = {k: v.collect() for k, v in op.match_dag(lines(spark, a), lines(spark, b), max_distance=10.0, step=15.0).items()}
    assert {r.source_id: r.dest_ids for r in got["summary"]} == {"lone": "l"} | {f"{x}{k}": f"{y}{k}" for k in range(6) for x, y in (("in", "b"), ("up", "u"), ("down", "d"))}
    assert sorted((sorted(r.sources), r.error.split(":")[0]) for r in got["errors"]) == [(sorted([f"in{k}", f"up{k}", f"down{k}"]), "no edge is near") for k in (6,)] + [(sorted(["in7", "up7", "down7"]), "no edge is near"), (["loop"], "NotADag"), (["split"], "NoMatching")]
    assert len({round(r.cost, 9) for r in got["costs"] if len(r.sources) == 3}) == 1


def test_measured_pairs(spark):
    """Distances in arrays against the column expression, points and crossing lines included."""
    draw = random.Random(4)
    line = lambda: [(draw.randint(0, 12), draw.randint(0, 12)) for _ in range(draw.randint(1, 4))]
    a, b = lines(spark, {k: line() for k in range(40)}), lines(spark, {k: line() for k in range(40)})
    pairs = a.select(F.col("id").alias("id_a"), F.col("pts").alias("pts_a")).crossJoin(b.select(F.col("id").alias("id_b"), F.col("pts").alias("pts_b")))
    for radius in (0.0, 1.0, 3.0, math.sqrt(5)):
        want = {(r.id_a, r.id_b) for r in pairs.where(G.line_distance(F.col("pts_a"), F.col("pts_b")) <= radius).collect()}
        assert {(r.id_a, r.id_b) for r in spatial.measured(pairs, radius).collect()} == want and 0 < len(want) < 1600


def test_components_by_shared_vertices(spark):
    """Names and members as by all vertices."""
    draw = random.Random(9)
    a = lines(spark, {k: [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(draw.randint(2, 3))] for k in range(400)})
    key = lambda p: F.concat_ws(",", F.round(p["x"], 3).cast("string"), F.round(p["y"], 3).cast("string"))
    every = connected_components(a.select(key(F.col("pts")[0]).alias("u"), F.explode(F.transform("pts", key)).alias("v")))
    want = a.join(every, key(F.col("pts")[0]) == F.col("node")).select("id", "component")
    got = op.components_of(a).select("id", "component")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.select("component").distinct().count() > 20


def test_stretches_take_one_order(spark):
    """Rows are sorted once by the order of travel for their windows, and not tripled to count different segments."""
    a, b = {k: [(0, 500 * k), (40, 500 * k)] for k in range(4)}, {k: [(20 * (k % 2), 500 * (k // 2) + 1), (20 * (k % 2) + 20, 500 * (k // 2) + 1)] for k in range(8)}
    plan = op.match_dag(lines(spark, a), lines(spark, b), max_distance=10.0, step=10.0)["parts"]._jdf.queryExecution().executedPlan().toString()
    assert "a_seq#" in plan and "DESC" not in plan and "Expand" not in plan


def test_one_shape_at_any_place():
    """Streets with a fork or a block have one shape wherever they lie, however their coordinates round."""
    draw = random.Random(3)
    for kind in (2, 3):
        comps = []
        for _ in range(40):
            x, y = draw.uniform(-1e5, 1e5), draw.uniform(-1e5, 1e5)
            comps.append([[(int(s[0]), [(s[1 + k] + x + d, s[2 + k] + y + d) for k in (0, 2, 4)]) for s in shapes[kind]] for shapes, d in ((derived.A_SHAPES, 0.0), (derived.B_SHAPES, 0.3))])
        a, b = nets(comps, 0, 15.0), nets(comps, 1, 15.0)
        s = batch.solve(a, b, batch.candidates(a, b, 12.0, 0.1, 1), 1.0, 1.0, 2_000_000)
        assert np.isfinite(s.cost).sum() >= 36
