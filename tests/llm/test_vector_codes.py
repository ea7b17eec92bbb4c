from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from spanframe.llm import vector_codes
from spanframe.llm.vector_codes import code_text, compress, with_label_error


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """{(id, code, error)} and the codebooks' digest, by plain integers."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    edges = [p * len(kept[0][1]) // parts for p in range(parts + 1)]
    cut = lambda v, p: v[edges[p] : edges[p + 1]]
    first = sorted(kept)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(v, p)[1] for p in range(parts)] for _, v in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                if mine := [cut(v, p) for (_, v), code in zip(kept, found, strict=True) if code[p] == j]:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v in kept:
        best = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(e for e, _ in best)))
    return sorted(out), hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()


def found(frame, **options):
    coded, books = compress(frame, **options)
    return sorted((r["vec_id"], r["code"], r["error"]) for r in coded.select("vec_id", code_text().alias("code"), "error").collect()), books


@pytest.mark.parametrize("dim,scale,entries", [(64, 256.0, 64), (16, 2.0, 5), (20, 1e6, 7), (3, 256.0, 3)])
def test_against_brute_force(spark, monkeypatch, dim, scale, entries):
    monkeypatch.setattr(vector_codes, "BLOCK", 60)
    monkeypatch.setattr(vector_codes, "GATHER", 200)
    rng = np.random.default_rng(dim)
    x = np.round(rng.normal(size=(300, dim)), 2)
    x[50:90] = x[50]  # ties and unused entries
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(300), x, strict=True)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int")
    got, books = found(frame, scale=scale, entries=entries)
    want, sha = brute(rows, entries=entries, scale=scale)
    assert got == want and books.sha256 == sha


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**40 * (i % 3)) + i, -float(2**52) * (i % 2)] * 8) for i in range(5)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int")
    got, books = found(frame, scale=1.0, entries=5)
    assert (got, books.sha256) == brute(rows, scale=1, entries=5)
    with pytest.raises(Exception, match="too large"):
        compress(spark.createDataFrame([(1, [1e300] * 16, 1)], frame.schema))


def test_odd_rows(spark):
    good = [float(i) for i in range(16)]
    rows = [(1, good, 5, "x"), (1, good[::-1], None, "x"), (None, good, None, "y"), (2, None, 5, "z"), (3, [None, *good[1:]], 5, "z"), (4, [float("nan"), *good[1:]], 5, "z"), (5, [float("inf"), *good[1:]], 5, "z"), (6, [1.0], 5, "z"), (7, [], 5, "z"), (8, [0.5] * 16, 5, "w"), (8, [0.5] * 16, 5, "w")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, codes string")
    coded, books = compress(frame, entries=2)
    out = with_label_error(coded).collect()
    assert sorted((r["vec_id"] or 0) for r in out) == [0, 1, 1, 8, 8] and len(books.entries[0]) == 2
    for label in (5, None):
        mine = [r for r in out if r["label"] == label]
        assert mine and all(r["label_error"] == sum(x["error"] for x in mine) for r in mine)
    empty, none = compress(frame.limit(0))
    assert empty.count() == 0 and none is None and with_label_error(empty).count() == 0
    nothing, _ = compress(frame.where("vec_id = 7"))
    assert [r["codes"] for r in nothing.collect()] == [[0] * 16]
    with pytest.raises(ValueError):
        compress(frame, entries=257)


def test_hot_labels_meet_their_sum_by_a_broadcast(spark, monkeypatch):
    from spanframe.llm import _base

    monkeypatch.setattr(_base, "HEAVY", 10)
    frame = spark.range(300).selectExpr("id as vec_id", "if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as label", "id as error")
    total = {}
    for r in frame.collect():
        total[r["label"]] = total.get(r["label"], 0) + r["error"]
    out = with_label_error(frame).collect()
    assert len(out) == 300 and all(r["label_error"] == total[r["label"]] for r in out)
