from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm import topk
from spanframe.llm.topk import top_k


def brute(rows, k, step):
    ok = [(i, np.floor(64 * np.array(v, dtype=np.float64))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % step == 0:
            scores = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("dim,spread,first", [(64, 1.0, 64), (7, 1.0, 2), (64, 0.02, 1), (1, 1.0, 2)])
def test_exact(spark, monkeypatch, dim, spread, first):
    rng = np.random.default_rng(dim)
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 9000)
    monkeypatch.setattr(topk, "FIRST", first)
    center = rng.normal(size=(5, dim))
    x = (center[rng.integers(0, 5, size=700)] + spread * rng.normal(size=(700, dim))).astype(np.float32)
    x[100:160] = x[100]  # ties
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {tuple(r) for r in top_k(frame, F.col("vec_id") % 20 == 0).collect()}
    assert got == brute(rows, 20, 20)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], "a"), (20, [2.0, 1.0], "b"), (1, None, "c"), (2, [None, 1.0], "c"), (40, [float("nan"), 1.0], "c"), (3, [float("inf"), 0.0], "c"), (4, [], "c"), (None, [1.0, 1.0], "c"), (5, [-1.0, 0.5], "d"), (60, [1.0], "e"), (6, [2.0], "f")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string")
    got = {tuple(r) for r in top_k(frame, F.col("vec_id") % 20 == 0).collect()}
    assert got == brute([r[:2] for r in rows], 20, 20)
    assert top_k(frame.limit(0), F.lit(True)).count() == 0


def test_query_rows_of_one_id_and_overflow(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, top_k(frame, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 4096), (0, 1, 2, 4096), (0, 2, 1, 0), (0, 2, 2, 0)]
    with pytest.raises(ValueError, match="too long"):
        top_k(spark.createDataFrame([(0, [2.0**52]), (1, [1.0])], "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0)


def test_repeated_rows_are_candidates_each(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    rows = [(i, [float(i % 7), 1.0, -float(i % 3)]) for i in range(90)]
    frame = spark.createDataFrame(rows + rows[:10], "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(frame.where("vec_id > 0").union(frame.where("vec_id = 0").limit(1)), F.col("vec_id") % 20 == 0, k=5).collect())
    ints = [(i, [64 * x for x in v]) for i, v in rows + rows[1:10]]
    want = []
    for i, q in [r for r in ints if r[0] % 20 == 0]:
        scores = sorted((-int(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in ints if j != i)[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    assert got == sorted(want)
