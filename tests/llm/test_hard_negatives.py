from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm import hard_negatives as mining
from spanframe.llm._vectors import Best
from spanframe.llm.cover_tree import BASE, Search, Tree, build
from spanframe.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label string"


def brute(rows, step=50, positives=5, negatives=3, least=50, most=95):
    kept = [(i, [math.floor(256 * c) for c in v], x) for i, v, x in rows if i is not None and x is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q, label in kept:
        if i % step:
            continue
        others = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, x) for j, v, x in kept if j != i and len(v) == len(q))
        for s, j, _ in [o for o in others if o[2] == label][:positives]:
            fits = [(t, n) for t, n, x in others if x != label and least * -s <= 100 * -t <= most * -s]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("dim,spread,first", [(32, 0.1, 64), (8, 1.0, 1), (2, 0.3, 2)])
def test_against_brute_force(spark, monkeypatch, dim, spread, first):
    monkeypatch.setattr(mining, "BLOCK", 100)
    monkeypatch.setattr(mining, "FIRST", first)
    monkeypatch.setattr(mining, "CHUNK_BYTES", 2000)
    rng = np.random.default_rng(dim)
    center = rng.normal(size=(12, dim))
    at = rng.integers(0, 12, size=700)
    x = np.round(center[at] + spread * rng.normal(size=(700, dim)), 3)
    x[100:200] = x[100]  # ties, within labels and across
    rows = [(i, [float(c) for c in v], str(k % 5)) for i, (v, k) in enumerate(zip(x, at + (rng.random(700) < 0.3), strict=True))]
    want = brute(rows)
    assert len(want) > 50
    got = sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()))
    assert got == want


def test_odd_rows(spark):
    v = [1.0, 0.5]
    rows = [(0, v, "a"), (1, v, "a"), (2, [0.8, 0.4], "b"), (3, None, "a"), (4, v, None), (None, v, "a"), (5, [None, 1.0], "b"), (6, [float("nan"), 1.0], "b"), (7, [float("inf"), 1.0], "b"), (8, [], "b"), (9, [1.0], "b"), (50, [-1.0, 0.0], "c"), (100, [0.0, 0.0], "d"), (101, [0.0, 0.0], "d"), (150, [1.0], "b"), (10, [0.9], "z")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash"))
    got = sorted(map(tuple, hard_negatives(frame, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows) and {r[0] for r in got} == {0, 100, 150}
    assert hard_negatives(frame.limit(0), F.lit(True)).count() == 0
    assert hard_negatives(frame, F.lit(False)).count() == 0
    twice = hard_negatives(frame.union(frame.where("vec_id = 0")), F.col("vec_id") == 0).collect()
    assert len(twice) == 2 * len([r for r in got if r[0] == 0])
    with pytest.raises(ValueError, match="too long"):
        hard_negatives(spark.createDataFrame([(0, [2.0**45], "a")], SCHEMA), F.lit(True))


def tree_of(x):
    sphere = float((x * x).sum(axis=1).max())
    order, nodes = build(x, sphere)
    return Tree(x[order], nodes, sphere), order


def test_levels_cover_separate_and_nest():
    rng = np.random.default_rng(1)
    center = 40 * rng.normal(size=(9, 6))
    x = np.floor(center[rng.integers(0, 9, size=900)] + rng.normal(size=(900, 6)))
    tree, order = tree_of(x)
    n = tree.nodes
    assert sorted(order.tolist()) == list(range(900)) and len(n["center"]) > 9
    wide = np.column_stack((tree.points, np.sqrt(tree.sphere - (tree.points**2).sum(axis=1))))
    for i in range(len(n["center"])):
        members = np.arange(n["begin"][i], n["end"][i])
        far = np.linalg.norm(wide[members] - wide[n["center"][i]], axis=1)
        assert abs(far.max() - n["radius"][i]) < 1e-6 and n["center"][i] in members
        if n["children"][i]:
            mine = np.arange(n["child"][i], n["child"][i] + n["children"][i])
            assert n["center"][i] in n["center"][mine]
            assert n["begin"][mine[0]] == n["begin"][i] and n["end"][mine[-1]] == n["end"][i] and (n["end"][mine[:-1]] == n["begin"][mine[1:]]).all()
            assert (n["radius"][mine] <= n["radius"][i] / BASE + 1e-6).all()
            apart = np.linalg.norm(wide[n["center"][mine]][:, None] - wide[n["center"][mine]][None], axis=2)
            assert (apart[~np.eye(len(mine), dtype=bool)] > n["radius"][i] / BASE - 1e-6).all()


def test_descent_skips_nodes_outside_the_windows():
    rng = np.random.default_rng(2)
    center = 100 * rng.normal(size=(20, 16))
    x = np.floor(center[rng.integers(0, 20, size=2000)] + rng.normal(size=(2000, 16)))
    tree, order = tree_of(x)
    q = x[:40]
    scores = q @ tree.points.T
    best = np.sort(scores, axis=1)[:, ::-1]
    for lo, hi in ((np.full(40, -np.inf), np.full(40, np.inf)), (best[:, 900], best[:, 300])):
        search = Search(q, np.full(40, -1), np.zeros(40, int), lo[:, None], hi[:, None], 3, True)
        checked, every = search.offer(tree, order, np.zeros(2000, int))
        inside = np.where((scores >= lo[:, None]) & (scores <= hi[:, None]), scores, -np.inf)
        assert (np.sort(inside, axis=1)[:, ::-1][:, :3] == search.best.scores.reshape(40, 3)).all()
        assert checked < every / 3, (checked, every)


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.merge(np.array([0, 0, 0]), np.array([1.0, 2.0, 2.0]), np.array([5, 9, 7]))
    best.merge(np.array([0, 1]), np.array([2.0, 0.0]), np.array([3, 1]))
    assert best.ids[0].tolist() == [3, 7] and best.scores[0].tolist() == [2.0, 2.0] and best.ids[1, 0] == 1 and np.isinf(best.scores[1, 1])
    assert best.floors(np.array([0, 1])).tolist() == [2.0, -np.inf]
