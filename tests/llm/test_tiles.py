"""Hard negatives: partial tiles added where they are made, and by a shuffle where vectors are wide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import hard_negatives as H

from .test_round_three import compare, vectors


def crowd(seed, n=500):
    """Vectors of few different numbers, so that many scores tie; labels of all sizes."""
    draw = np.random.default_rng(seed)
    return [(int(k) if k % 11 else None, int(y), (draw.integers(-2, 5, 6) / 8).tolist()) for k, y in enumerate(draw.choice(5, n, p=[0.5, 0.3, 0.1, 0.06, 0.04]))]


@pytest.mark.parametrize("wide", [0, 4096])
def test_both_ways_of_adding(spark, wide):
    got = compare(spark, crowd(3), panel=32, per_anchor_panel=4, depth=3, wide=wide)
    assert len(got) > 1000


def test_many_groups(spark, monkeypatch):
    """Groups of one panel, and best rows that are spread over them."""
    monkeypatch.setattr(H, "GROUP", 1)
    monkeypatch.setattr(H, "ANCHOR_GROUP", 1)
    assert len(compare(spark, crowd(4), panel=32, per_anchor_panel=4)) > 1000


def test_no_tile_is_shuffled(spark):
    """What crosses the network grows with the rows, not with the scores: no stage but that of the product has tiles."""
    df = H.mine(vectors(spark, crowd(5)), F.col("id") % 10 == 0, panel=32, per_anchor_panel=4)
    plan = df._jdf.queryExecution().toString()
    assert "tile" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert "tile" in H.mine(vectors(spark, crowd(5)), F.col("id") % 10 == 0, wide=0)._jdf.queryExecution().toString()


def test_scores_are_exact_in_every_kind():
    draw = np.random.default_rng(2)
    for top, kind in ((200, np.float32), (10**6, np.float64), (2**30, np.int64)):
        a, b = (draw.integers(-top, top, (7, 9)) for _ in range(2))
        s = H.scores([a[:, :4], a[:, 4:]], [b[:, :4], b[:, 4:]])
        assert s.dtype == kind and (s.astype(np.int64) == a @ b.T).all()


def test_best_rows_in_parts_equal_the_whole():
    draw = np.random.default_rng(6)
    pair, score, unnamed, ids, row = (draw.integers(0, m, 4000) for m in (7, 30, 2, 40, 10**6))
    best = H._Best(7, 10, np.full(7, -1))
    for part in np.array_split(np.arange(4000), 9):
        best.add(pair[part], score[part], unnamed[part], ids[part], row[part])
    best.settle()
    want = [x for p in range(7) for x in sorted(zip(pair, -score, unnamed, ids, row, strict=True))[:] if x[0] == p]
    want = [x for p in range(7) for x in [w for w in want if w[0] == p][:10]]
    assert list(zip(best.pair, -best.score, best.unnamed, best.id, best.row, strict=True)) == want
    assert best.low.tolist() == [-want[10 * p + 9][1] for p in range(7)]
