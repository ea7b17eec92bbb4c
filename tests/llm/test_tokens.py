from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanframe.llm import encoder as encoding
from spanframe.llm import pfor, token_files
from spanframe.llm.queries import tokenizer_file
from spanframe.llm.token_counts import cut_totals, length_histogram, length_quantiles
from spanframe.llm.token_files import read_token_files, token_digests, write_token_files


@pytest.fixture(scope="module")
def code():
    return encoding.encoder(tokenizer_file())


def whole(code, text):
    return code.whole.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n'’.,!sStTlL<|>ÉßİŸ½²日🙂́\x85\x1c  "))))
def test_memo_equals_the_library(text):
    code = encoding.encoder(tokenizer_file())
    assert code.encode(text).tolist() == whole(code, text)


def test_special_strings_long_words_and_full_memos(code, monkeypatch):
    monkeypatch.setattr(encoding, "MEMO", 3)
    for text in ("a <|endoftext|> b", "<|startoftext|>", "x" * 300 + " don't we'll I'M", "ΑΣ Σ", "one two three four five one two", "<| x |>", ""):
        assert code.encode(text).tolist() == whole(code, text) and code.count(text) == len(whole(code, text))
    assert code.encode(None).tolist() == []


def test_frequent_words_outlive_a_memo_full_of_rare_ones(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO", 10)
    code = encoding.Encoder(tokenizer_file())
    for i in range(40):
        text = f"common {'abcdefgh'[i % 8] * (i + 2)}"
        assert code.encode(text).tolist() == whole(code, text)
        assert len(code.words) + len(code.old_words) <= 20 and len(code.chunks) + len(code.old_chunks) <= 20
        assert "common" in {**code.chunks, **code.old_chunks}
    asked = []
    monkeypatch.setattr(code, "_word", lambda w: asked.append(w) or b"")
    code.encode("common")
    assert not asked


def test_other_files_go_through_the_library():
    other = encoding.Encoder(tokenizer_file("byte_bpe_50k.json"))
    assert not other.known and other.encode("Hello  World\n").tolist() == whole(other, "Hello  World\n")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=200), st.floats(1, 100))
def test_blocks_round_trip(values, percentile):
    v = np.array(values, dtype=np.uint32)
    data, starts = pfor.encode(v, percentile)
    assert pfor.decode(data, starts).tolist() == values


def test_blocks_are_indexed_and_patched():
    rng = np.random.default_rng(0)
    v = rng.integers(1000, 1100, size=10_000).astype(np.uint32)
    v[::100] = 4_000_000_000
    data, starts = pfor.encode(v)
    assert len(starts) == 3 and len(data) < 1.6 * len(v)
    assert pfor.decode(data, starts, 4090, 20).tolist() == v[4090:4110].tolist()
    assert pfor.decode_block(data, starts[2]).tolist() == v[8192:].tolist()


def brute(code, rows):
    at, out = 0, []
    for i, t in rows:
        ids = np.array([*whole(code, t), 2], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_round_trip(spark, code, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 50)
    random.seed(1)
    rows = [(i * 3, " ".join(random.choice(["Été", "the", "ox", "7", "don't"]) for _ in range(random.randrange(0, 60))) or None) for i in range(200)]
    frame = spark.createDataFrame(random.sample(rows, len(rows)), "doc_id bigint, text string").repartition(5)
    write_token_files(frame, f"{tmp_path}/t", tokenizer_file())
    got = sorted(map(tuple, token_digests(spark, f"{tmp_path}/t").collect()))
    assert got == brute(code, rows)
    read = {r["id"]: r["ids"] for r in read_token_files(spark, f"{tmp_path}/t").collect()}
    assert read == {i: [*whole(code, t), 2] for i, t in rows}
    parts = spark.read.parquet(f"{tmp_path}/t").select("part", "chunk", "offset", "n_ids", "doc_ids").collect()
    assert len(parts) > 20 and sum(r["n_ids"] for r in parts) == sum(n for _, _, n, _ in got)
    order = [d for r in sorted(parts, key=lambda r: (r["part"], r["chunk"])) for d in r["doc_ids"]]
    assert order == sorted(order)


def test_odd_tables(spark, code, odd_docs, no_docs, tmp_path):
    write_token_files(odd_docs.union(odd_docs), f"{tmp_path}/a", tokenizer_file())
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.orderBy("doc_id").collect() for _ in range(2)]
    assert sorted(map(tuple, token_digests(spark, f"{tmp_path}/a").collect())) == brute(code, texts)
    write_token_files(no_docs, f"{tmp_path}/b", tokenizer_file())
    assert token_digests(spark, f"{tmp_path}/b").count() == 0


def test_histogram_answers_every_limit(spark, code, odd_docs, no_docs):
    lengths = {}
    for r in odd_docs.collect():
        lengths.setdefault(r["source"], []).append(len(whole(code, r["text"])))
    histogram = length_histogram(odd_docs, tokenizer_file(), by="source")
    rows = histogram.collect()
    assert len(rows) == sum(len(set(x)) for x in lengths.values())
    for r in rows:
        x, n = lengths[r["source"]], r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (x.count(n), sum(y >= n for y in x), sum(y for y in x if y >= n))
        assert (r["docs_total"], r["tokens_total"], r["tokens_cut"]) == (len(x), sum(x), sum(min(y, n) for y in x))
        assert r["share_at_most"] == pytest.approx(sum(y <= n for y in x) / len(x))
    cut = {(r["source"], r["limit"]): (r["tokens_cut"], r["docs_longer"]) for r in cut_totals(histogram, [0, 5, 1000, 10**6], "source").collect()}
    assert cut == {(s, m): (sum(min(y, m) for y in x), sum(y > m for y in x)) for s, x in lengths.items() for m in (0, 5, 1000, 10**6)}
    half = {r["source"]: r["n_tokens"] for r in length_quantiles(histogram, [0.5], "source").collect()}
    assert half == {s: sorted(x)[(len(x) + 1) // 2 - 1] for s, x in lengths.items()}
    assert length_histogram(no_docs, tokenizer_file()).count() == 0
    assert length_histogram(odd_docs, tokenizer_file()).agg({"n_docs": "sum"}).first()[0] == 11


def test_a_word_between_spaces_is_kept_once():
    from public_tokenizers import path

    code = encoding.Encoder(path("word_bpe_49k.json"))
    for text in ("alpha beta, (Gamma) delta", "beta gamma, alpha. delta!"):
        assert code.encode(text).tolist() == code.whole.encode(text, add_special_tokens=False).ids
    assert {"alpha", "delta"} <= set(code.chunks) and not {"alpha", "delta"} & set(code.words)
