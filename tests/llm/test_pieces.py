from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanframe.llm import pieces as coding
from spanframe.llm.pieces import decode_pieces, encode_pieces
from spanframe.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcdefghilnorst    \n\t▁.,<>0x日本é́🙂\x00\r")), max_size=60))
def test_agenda_equals_the_library(text):
    code = coding.pieces(MODEL)
    assert code.encode(text) == code.library.encode(text)
    whole = code._agenda("▁" + text.replace(" ", "▁")) if text else b""
    assert code.packed(text) == whole  # chunks change nothing
    assert code.decode([code.encode(text)]) == [code.library.decode(code.library.encode(text))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdefghilnorst.,*é'▁ABЖ日", min_size=1, max_size=14), max_size=12))
def test_agendas_in_a_matrix_equal_the_heap(words):
    code = coding.pieces(MODEL)
    plain = [coding.SPACE + w for w in set(words) if code.letters.issuperset(w)]
    assert dict(code._agendas(plain)) == {w: code._agenda(w) for w in plain}
    text = " ".join(words)
    code.learn([text, None, "", f"{text}\n{text}"])
    assert code.encode(text) == code.library.encode(text)


def test_full_memo_and_long_texts(monkeypatch):
    monkeypatch.setattr(coding, "MEMO", 3)
    code = coding.Pieces(MODEL)
    rng = random.Random(4)
    assert list(code._agendas([])) == []
    for text in ("one two three four five one two", "ab" * 50_000, " " * 3000 + "x", "\n\n a\nb \n", "".join(rng.choice("aeiou tnrs") for _ in range(20_000)), None, ""):
        code.learn([text])
        assert code.encode(text) == code.library.encode(text or "")


def test_rows(spark, monkeypatch, odd_docs, no_docs):
    monkeypatch.setattr(coding, "TOGETHER", 40)
    library = coding.pieces(MODEL).library
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    out = {r["doc_id"]: r for r in encode_pieces(odd_docs, MODEL, decode=True).collect()}
    assert {i: r["ids"] for i, r in out.items()} == {i: library.encode(t) for i, t in texts.items()}
    assert {i: r["decoded"] for i, r in out.items()} == {i: library.decode(library.encode(t)) for i, t in texts.items()}
    assert encode_pieces(no_docs, MODEL, decode=True).count() == 0
    frame = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, None, 3)], "doc_id bigint, text string, ids int")
    plain = encode_pieces(frame, MODEL)
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in plain.collect()) == [(0, 2), (3, 0), (3, 2)]
    assert sorted(r["decoded"] for r in decode_pieces(plain, MODEL).collect()) == ["", "a b", "a b"]
    odd = spark.createDataFrame([(1, None), (2, [263, None, 10**6, -1]), (3, [])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in decode_pieces(odd, MODEL).collect()}
    assert got[1] is None and got[3] == "" and got[2] == library.decode([263, 0, 0])


def test_a_difference_from_the_library_is_an_error():
    code = coding.Pieces(MODEL)
    ids = np.array(code.encode("water") + code.encode("fire"))
    assert code.checked(["water", "fire", None], [1, len(ids) - 1, 0], ids)[2] == []
    for sizes, wrong in (([2, len(ids) - 2, 0], ids), ([1, len(ids) - 1, 0], ids + 1), ([1, len(ids), 0], np.append(ids, 5))):
        with pytest.raises(ValueError, match="differ"):
            code.checked(["water", "fire", None], sizes, wrong)


def test_other_kinds_are_refused(tmp_path):
    import sentencepiece

    text = tmp_path / "text.txt"
    assert sentencepiece and text.parent.exists()
    data = bytearray(open(MODEL, "rb").read())
    fields = list(coding._fields(bytes(data)))
    spec = next(v for n, v in fields if n == 3)
    assert dict(coding._fields(spec))[1] == b"identity"
    data[data.rfind(b"identity") : data.rfind(b"identity") + 8] = b"nmt_nfkc"
    bad = tmp_path / "bad.model"
    bad.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="normalizer"):
        coding.Pieces(str(bad))
