from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from spanframe.llm import decontam
from spanframe.llm.decontam import contaminated_spans, contamination, remove_spans, words_of
from spanframe.llm.fm_index import FMIndex

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=13):
    windows = {}
    for name, text in items:
        w = WORDS.findall(lower(text))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    out = {}
    for name, text in docs:
        w = WORDS.findall(lower(text))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k] - {"None"}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[name] = (len(w), len(hit), len(found), digest, 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("separators", [0.05, 0.5])
def test_index_finds_all_occurrences(separators):
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, v = int(rng.integers(1, 150)), int(rng.integers(1, 6))
        text = np.where(rng.random(n) < separators, 0, rng.integers(1, v + 1, size=n))
        phrases = [rng.integers(1, v + 1, size=int(rng.integers(1, 6))) for _ in range(20)]
        table = np.zeros((20, 5), dtype=np.int64)
        for row, p in zip(table, phrases, strict=True):
            row[5 - len(p) :] = p
        index = FMIndex(text, v)
        found = {int(i): sorted(index.locate(np.arange(a, b)).tolist()) for i, a, b in zip(*index.search(table, np.array([len(p) for p in phrases])), strict=True)}
        for i, p in enumerate(phrases):
            assert found.get(i, []) == [j for j in range(n - len(p) + 1) if (text[j : j + len(p)] == p).all()]


def test_long_copies_are_indexed_fast():
    text = np.tile(np.append(np.arange(1, 2000), 0), 50)
    index = FMIndex(text, 2000)
    found, lo, hi = index.search(np.array([[7, 8, 9]]), np.array([3]))
    assert hi[0] - lo[0] == 50 and len(set(index.locate(np.arange(lo[0], hi[0])).tolist())) == 50


def test_contract_against_brute_force(spark, monkeypatch):
    random.seed(5)
    word = lambda: random.choice(["Alpha", "beta", "été", "x1", "gamma", "Δ", "the"])
    items = [(i, " ".join(word() for _ in range(random.choice([2, 5, 13, 14, 30])))) for i in range(12)] + [(90, ""), (91, None), (92, "?!"), (None, "gamma Alpha x1")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(random.randrange(0, 120))]
        if i % 3 == 0:
            text[3:3] = random.choice(items[:12])[1].upper().split() if i % 2 else random.choice(items[:12])[1].split()
        docs.append((i, ", ".join(text) if text else None))
    expected = brute(docs, items)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for shard, block in ((400_000, 1_000_000), (50, 20)):
        monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in contamination(frame, bench).collect()}
        assert got == expected


def test_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old river bank"), (1, "clocks were striking")], "item_id bigint, text string")
    out = {r["doc_id"]: r for r in contamination(odd_docs, bench, keep=("text", "id")).collect()}
    assert len(out) == 11 and out[0]["n_hit"] == 16 and out[0]["n_items"] == 1 and out[3]["n_words"] == 0 and not out[6]["contaminated"]
    assert out[0]["text"] == odd_docs.where("doc_id = 0").first()["text"] and out[2]["n_hit"] == 3
    assert contamination(no_docs, bench).count() == 0
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert [r["n_hit"] for r in contamination(odd_docs, nothing).collect()] == [0] * 11
    assert contaminated_spans(odd_docs, nothing).where("n_words > 0").count() == 8


def test_remove_spans():
    assert remove_spans("One two, three four. Five", [(1, 3)]) == "One four. Five"
    assert remove_spans("a b", [(0, 2)]).strip() == "" and remove_spans(None, [(0, 1)]) is None
    assert words_of("Ab-c d'É 9") == [b"ab", b"c", b"d", "É".encode(), b"9"]


def test_ids_may_repeat_or_be_null_and_texts_be_long(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (None, "lone words")], "item_id bigint, text string")
    docs = [(3, "alpha beta gamma delta"), (3, "nothing here"), (None, "x alpha beta gamma"), (4, "lone words"), (4, "lone words"), (5, "filler " * 500_000 + "Alpha, BETA gamma")]
    out = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()))
    assert out == sorted([(3, 4, 3, 1), (3, 2, 0, 0), (0, 4, 3, 1), (4, 2, 2, 0), (4, 2, 2, 0), (5, 500_003, 3, 1)])
