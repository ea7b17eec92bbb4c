from __future__ import annotations

from pyspark.sql import functions as F

import numpy as np
from spanframe.llm.lang_id import Classifier, crc_mod, gram_counts, gram_text, identify_languages, learn_profiles

EN = "the cat sat on the mat and the dog was in the house with the other animals while it rained"
DE = "der hund lag auf der matte und die katze war in dem haus mit den anderen tieren während es regnete"


def grams(text):
    return np.repeat(*gram_counts(text))


def test_grams_of_words():
    found = sorted(gram_text(int(g)) for g in grams("Ab, a"))
    assert found == sorted(["a", "b", "_a", "ab", "b_", "_ab", "ab_", "a", "_a", "a_", "_a_"])
    assert len(grams(None)) == len(grams("12 !")) == 0


def test_out_of_place_distance():
    c = Classifier([("x", int(g), r) for r, g in enumerate(dict.fromkeys(grams("aab").tolist()), 1)], ranks=300)
    assert c.predict("aab")[0] == "x"
    lang, score = c.predict("zz")
    assert lang == "x" and score == 0.0  # nothing in the profile: every gram costs the most
    assert Classifier([]).predict("abc") == ("und", 0.0)


def test_profiles_rank_by_counts(spark):
    docs = spark.createDataFrame([("aa ab", "x"), ("a", "x"), ("b", None)], "text string, lang string")
    got = {gram_text(r["gram"]): (r["n"], r["rank"]) for r in learn_profiles(docs).collect()}
    assert got["a"] == (4, 1) and got["b"][0] == 1 and got["_a"] == (3, 2)


def test_identifies_and_keeps_every_row(spark, odd_docs, no_docs):
    known = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de")] * 6)], "doc_id bigint, text string, lang string")
    out = identify_languages(known, crc_mod(F.col("doc_id"), 4) != 2).collect()
    assert len(out) == 12 and all(r["lang_pred"] == ("en", "de")[r["doc_id"] % 2] and 0 <= r["score"] <= 1 for r in out)
    odd = {r["doc_id"]: r for r in identify_languages(odd_docs, F.lit(True), keep=("id", "source")).collect()}
    assert len(odd) == 11 and odd[7]["lang_pred"] == "de" and odd[8]["lang_pred"] == "ja"
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (3, 4, 5, 10)) and odd[2]["id"] == "y"
    assert identify_languages(no_docs, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in identify_languages(known, F.lit(False)).collect()} == {"und"}


def brute_grams(text):
    from collections import Counter

    words, now = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            now += c
        elif now:
            words.append(now)
            now = ""
    found = Counter()
    for w in words:
        found.update(w)
        found.update((" " + w)[i : i + 2] for i in range(len(w)))
        found.update([w[-1] + " "])
        found.update((" " + w + " ")[i : i + 3] for i in range(len(w)))
    return found


def brute_predict(docs, learns, ranks):
    """docs: (id, text, lang) -> {id: (lang, score)} by the out-of-place distance; ties by the gram's number, as the operator."""

    def number(gram):
        n = 0
        for c in gram:
            n = (n << 21) | (0 if c == " " else ord(c))
        return n + (1 << (62, 63)[len(gram) - 1] if len(gram) < 3 else 0)

    def top(found, signed):
        key = lambda g: number(g) - (1 << 64) * (signed and number(g) >= 1 << 63)
        return sorted(found, key=lambda g: (-found[g], key(g)))[:ranks]

    from collections import Counter

    total = {}
    for i, text, lang in docs:
        if learns(i) and lang is not None:
            total.setdefault(lang, Counter()).update(brute_grams(text))
    profiles = {lang: {g: r for r, g in enumerate(top(c, True))} for lang, c in total.items() if c}
    out = {}
    for i, text, _ in docs:
        mine = top(brute_grams(text), False)
        off = {lang: sum(abs(p[g] - r) if g in p else ranks for r, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(off, key=lambda x: (off[x], x)) if mine and off else "und"
        out[i] = (best, 1 - off[best] / (ranks * len(mine)) if mine and off else 0.0)
    return out


def made_docs():
    import random

    random.seed(6)
    spell = {"en": "the and ing tion ed er".split(), "de": "der und en sch ung ä".split(), "fr": "le eau ç é ment ou".split(), "xx": "the le und qu".split()}
    docs = [(i, " ".join("".join(random.choices(spell[lang], k=random.randrange(1, 5))) for _ in range(random.randrange(1, 60))).title(), lang) for i, lang in enumerate(random.choices(list(spell), k=80))]
    return docs + [(100, None, "en"), (101, "12 3", "de"), (102, "the the", None), (103, "word " * 400_000, "en")]


def test_every_prediction_against_brute_force(spark, monkeypatch):
    import pytest

    from spanframe.llm import lang_id

    docs = made_docs()
    frame = spark.createDataFrame([*docs, *docs[:3]], "doc_id bigint, text string, lang string")
    expected = brute_predict([*docs, *[(200 + d[0], *d[1:]) for d in docs[:3]]], lambda i: i % 4 != 2 and not 200 <= i or (i - 200) in range(3) and (i - 200) % 4 != 2, 50)
    for block, held in ((1000, 2_000_000), (2, 30)):
        monkeypatch.setattr(lang_id, "BLOCK_LANGUAGES", block)
        monkeypatch.setattr(lang_id, "MOST_HELD", held)
        out = identify_languages(frame, F.col("doc_id") % 4 != 2, ranks=50).collect()
        assert len(out) == len(docs) + 3
        for r in out:
            assert (r["lang_pred"], r["score"]) == (expected[r["doc_id"]][0], pytest.approx(expected[r["doc_id"]][1], abs=1e-12))


def test_null_ids_teach_nothing_in_the_query(spark, tmp_path):
    from spanframe.llm.queries import op1_language_id

    rows = [(None, EN, "nil"), (None, DE, "nil"), *((i, EN, "en") for i in range(8))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op1_language_id(spark, str(tmp_path)).collect()
    assert len(out) == 10 and {r["lang_pred"] for r in out} == {"en"} and [r["held_out"] for r in out if r["doc_id"] is None] == [False] * 2
