from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanframe.llm.mixing import mix_sources


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """sizes: {source: words} -> {source: target}, the excess above cap times the size dealt again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        rest, w = total - sum(stopped.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > cap * sizes[s]]
        if not over:
            return stopped | {s: rest * weight[s] / w for s in free}
        stopped |= {s: cap * sizes[s] for s in over}


def corpus(spark, n, seed):
    random.seed(seed)
    rows = []
    for i in range(n):
        source = random.choice(["a", "b", "B", "é", None, "z"]) if random.random() < 0.6 else "hot"
        size = 40 if random.random() < 0.3 else int(random.lognormvariate(4, 1.2))
        rows.append((i, " ".join(["w"] * size) if size else None, source))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("n,seed", [(60, 1), (1500, 2), (1500, 3)])
def test_contract(spark, n, seed):
    docs = corpus(spark, n, seed)
    out = mix_sources(docs).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert len(out) == n
    sizes, taken, longest = {}, {}, {}
    for r in out:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]["text"] or ""))
        assert r["size"] == words and r["taken"] in (0, words, 2 * words) and r["source"] == texts[r["doc_id"]]["source"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + words
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        longest[r["source"]] = max(longest.get(r["source"], 0), words)
    expected = brute_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]], rel=1e-9)
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 0.5 * longest[s] + 1


def test_rates_are_clipped_exponentials_of_size_that_solve_the_dual(spark):
    docs = corpus(spark, 1500, 7)
    rows = [r for r in mix_sources(docs).collect() if r["size"]]
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        mass, target = sum(r["rate"] * r["size"] for r in own), own[0]["target"]
        assert abs(mass - target) <= max(0.5, 1e-6 * target)
        free = [r for r in own if 1e-9 < r["rate"] < 2 - 1e-9]
        if free:  # one multiplier tells every rate
            lam = math.log(free[0]["rate"]) / free[0]["size"]
            assert all(r["rate"] == pytest.approx(math.exp(min(math.log(2), lam * r["size"])), rel=1e-6) for r in own)
    assert any(1e-9 < r["rate"] < 1.9 for r in rows) and any(r["rate"] == 2 for r in rows)


def test_targets_hard_to_meet_are_met(spark):
    """One word above nothing, and one below the cap, with sizes from 1 to 10,000."""
    from spanframe.llm.mixing import balance

    sizes = [1, 2, 3, 50, 10_000]
    cells = spark.createDataFrame([(i, s, 3) for i in range(4) for s in sizes], "sid bigint, size bigint, n bigint")
    total = 3 * sum(sizes)
    wanted = {0: 1.0, 1: 2.0 * total - 1, 2: float(total), 3: 0.5 * total}
    sources = spark.createDataFrame([(i, total, t, False, total / 15) for i, t in wanted.items()], "sid bigint, source_size bigint, target double, capped boolean, mean double")
    for r in balance(cells, sources, 2).collect():
        got = sum(3 * s * math.exp(min(math.log(2), r["lam"] * s / r["mean"])) for s in sizes)
        assert abs(got - wanted[r["sid"]]) <= max(0.51, 1e-6 * wanted[r["sid"]])


def test_ids_may_repeat_or_be_null(spark):
    rows = [(1, "a b c", "x"), (1, "a b", "x"), (1, "a b", "x"), (None, "a", "x"), (None, "a b c d", None), (2, None, None)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), keep=("text",)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["source"] or "") for r in out) == sorted((i or 0, t or "", s or "") for i, t, s in rows)
    assert all(r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"] for r in out)


def test_reruns_agree(spark):
    docs = corpus(spark, 800, 11)
    a = {tuple(r) for r in mix_sources(docs).collect()}
    b = {tuple(r) for r in mix_sources(docs.repartition(7, "text")).collect()}
    assert a == b


def test_equal_documents_share_copies(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "'one two three four' as text", "if(id < 500, 'a', 'b') as source")
    out = mix_sources(docs, weights=(1, 3)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert {r["source"]: r["t"] for r in out} == {"a": 2000, "b": 4000} and all(abs(r["t"] - r["target"]) <= 2 for r in out)


def test_odd_tables(spark, odd_docs, no_docs):
    out = {r["doc_id"]: r for r in mix_sources(odd_docs).collect()}
    assert len(out) == 11 and all(out[i]["taken"] == 0 for i in (3, 4, 5)) and out[3]["source"] is None
    assert all(r["taken"] <= 2 * r["size"] for r in out.values())
    assert mix_sources(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "x")], "doc_id bigint, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2
    assert mix_sources(odd_docs.union(odd_docs)).count() == 22


def test_many_sources_are_not_broadcast(spark, monkeypatch):
    from spanframe.llm import mixing

    docs = corpus(spark, 120, 5)
    want = {tuple(r) for r in mix_sources(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert {tuple(r) for r in mix_sources(docs).collect()} == want
