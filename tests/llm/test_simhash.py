from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from spanframe.llm import simhash
from spanframe.llm._graph import components
from spanframe.llm.simhash import fingerprint, links, near_duplicates


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {id: fingerprint} -> {id: smallest id reachable}."""
    comp = {i: i for i in fps}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for text in (None, "", " \t", "One", "one TWO", "a b c d a b c", "Été été. x\x0by z\x1cq", "word " * 300, "日本 語 🙂"):
        assert fingerprint(text) == brute_fingerprint(text)


def linked(spark, fps):
    rows = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in fps.items()], "rep bigint, fp bigint")
    found = {r["node"]: r["component"] for r in components(links(rows)).collect()}
    return {i: found.get(i, i) for i in fps}


@pytest.mark.parametrize("hot", [4096, 40, 6])
def test_no_link_is_lost(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", hot // 2)
    random.seed(hot)
    fps = {}
    while len(fps) < 400:
        if fps and random.random() < 0.7:
            f = random.choice(list(fps.values()))
            for b in random.sample(range(64), random.randrange(1, 6)):
                f ^= 1 << b
        else:
            f = random.getrandbits(64)
        if f not in fps.values():
            fps[len(fps)] = f
    center = random.getrandbits(64)
    for i, b in enumerate(random.sample([(x, y) for x in range(20) for y in range(x)], 120)):  # one dense group
        fps[1000 + i] = center ^ (1 << b[0]) ^ (1 << b[1])
    assert linked(spark, fps) == brute_components(fps)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (2, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and 5000 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents(spark, odd_docs, no_docs):
    out = {r["doc_id"]: r for r in near_duplicates(odd_docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    expected = brute_components(fps)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out.items()} == {i: (f"{fps[i]:016x}", expected[i]) for i in fps}
    assert expected[5] == 3 and expected[1] == 0
    assert near_duplicates(no_docs).count() == 0
    twice = near_duplicates(odd_docs.union(odd_docs))
    assert twice.count() == 22 and twice.distinct().count() == 11


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)) + " " * 5000 + "end of it"
    for piece in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert fingerprint(text) == brute_fingerprint(text) and fingerprint("a  b") == brute_fingerprint("a  b")


def test_ids_may_repeat_or_be_null(spark):
    frame = spark.createDataFrame([(5, "one two three four"), (5, "other words are here now"), (None, "one two three four"), (None, "nobody else says this at all"), (6, None)], "doc_id bigint, text string")
    out = [(r["doc_id"], r["fingerprint"] == "0" * 16, r["component_id"]) for r in near_duplicates(frame).collect()]
    assert sorted(out, key=repr) == sorted([(5, False, 5), (5, False, 5), (None, False, 5), (None, False, None), (6, True, 6)], key=repr)
    with pytest.raises(TypeError):
        near_duplicates(frame.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_hubs_of_many_edges(spark, monkeypatch):
    from spanframe.llm import _base

    monkeypatch.setattr(_base, "HEAVY", 10)
    monkeypatch.setattr(_base, "HEAVY_KEYS", 20)
    edges = [(7, i) for i in range(100, 400)] + [(i, 9) for i in range(350, 600)] + [(1, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: 7 for n in [7, 9, *range(100, 600)]} | {1: 1, 2: 1}


def test_rows_without_an_id_link_and_shared_ids_do_not(spark):
    from pyspark.sql import functions as F

    base, found = [f"word{i} stays where it was" for i in range(40)], {}
    text = " ".join(base)
    for i in range(400):  # near copies of one text, whose fingerprints are a few bits apart
        other = text.replace(f"word{i % 40} ", f"v{i} ", 1)
        found[brute_fingerprint(other)] = other
    fps = list(found)
    chain = next((a, b, c) for b in fps for a in fps for c in fps if (a ^ b).bit_count() <= 3 and (b ^ c).bit_count() <= 3 and (a ^ c).bit_count() > 3)
    a, b, c = (found[x] for x in chain)
    frame = spark.createDataFrame([(1, a), (None, b), (3, c)], "doc_id bigint, text string")
    assert [r["component_id"] for r in near_duplicates(frame).collect()] == [1, 1, 1]
    frame = spark.createDataFrame([(3, a), (5, a), (5, "quite another text with words of its own"), (9, "quite another text with words of its own")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in near_duplicates(frame).collect()}
    other = f"{brute_fingerprint('quite another text with words of its own'):016x}"
    assert got == {(3, f"{chain[0]:016x}"): 3, (5, f"{chain[0]:016x}"): 3, (5, other): 5, (9, other): 5}
    assert near_duplicates(frame.where(F.lit(False))).count() == 0
