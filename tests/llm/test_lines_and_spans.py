from __future__ import annotations

import random

import xxhash

from spanframe.llm.line_dedup import dedup_lines
from spanframe.llm.span_dedup import all_runs_of, cut_sentences, dedup_spans, runs_of, sentences_of, units_of


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_lines(docs):
    blank = lambda x: not x.strip(" \t\r\x0b\x0c")
    first = {}
    for i, t in docs:
        for n, x in enumerate(t.split("\n") if t is not None else ()):
            if not blank(x):
                first.setdefault(x, (i, n))
    near = {x for x, f in first.items() if any(g < f and within_one(x, y) for y, g in first.items())}
    out = {}
    for i, t in docs:
        lines = t.split("\n") if t is not None else []
        kept = [x for n, x in enumerate(lines) if blank(x) or (first[x] == (i, n) and x not in near)]
        out[i] = (len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept))
    return out


def test_lines_against_brute_force(spark):
    random.seed(9)
    pool = ["".join(random.choice("abé🙂") for _ in range(random.randrange(0, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "x" * 3000, "x" * 2999 + "y", " ", "\t"]

    def line():
        x = list(random.choice(pool))
        for _ in range(random.choice([0, 0, 1, 1, 2])):
            k = random.randrange(0, len(x) + 1)
            x[k : k + random.randrange(2)] = random.choice([[], ["a"], ["ß"]])
        return "".join(x)

    docs = [(i, "\n".join(line() for _ in range(random.randrange(1, 6)))) for i in range(80)] + [(80, None), (81, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in dedup_lines(frame).collect()}
    assert got == brute_lines(docs)


def test_lines_of_odd_tables(spark, odd_docs, no_docs):
    out = {r["doc_id"]: r for r in dedup_lines(odd_docs, keep=("id", "h")).collect()}
    assert len(out) == 11 and out[1]["text"] == "" and out[1]["n_removed"] == 1 and out[0]["n_removed"] == 0
    assert out[9]["text"] == "a\n" and out[9]["n_removed"] == 3 and out[3]["text"] is None and out[0]["id"] == "x"
    assert out[6]["n_removed"] == 0 and out[5]["text"] == " \n\t "
    assert dedup_lines(no_docs).count() == 0
    twice = dedup_lines(odd_docs.union(odd_docs)).collect()
    assert len(twice) == 22 and sorted(r["text"] for r in twice if r["doc_id"] == 9) == ["", "a\n"]
    for i, r in out.items():
        assert [x["text"] for x in twice if x["doc_id"] == i].count(r["text"]) >= 1


def test_equal_rows_are_one_document_and_its_copies(spark, monkeypatch):
    from spanframe.llm import _base

    docs = [(None, "a line\n\nanother"), (None, "a line\n\nanother"), (None, "a line\n\nanother"), (3, "own line"), (3, "own line"), (3, "third of three"), (None, None), (None, None), (4, ""), (4, "")]
    frame = spark.createDataFrame([(*d, i, "z") for i, d in enumerate(docs)], "doc_id bigint, text string, n int, n_lines string")
    for heavy in (50_000, 1):
        monkeypatch.setattr(_base, "HEAVY", heavy)
        monkeypatch.setattr(_base, "HEAVY_KEYS", heavy)
        out = dedup_lines(frame, keep=("n",)).collect()
        assert sorted(r["n"] for r in out) == list(range(10))
        got = lambda ids: sorted((r["text"], r["n_lines"], r["n_removed"]) for r in out if r["n"] in ids)
        assert got({0, 1, 2}) == [("", 3, 2)] * 2 + [("a line\n\nanother", 3, 0)] and got({3, 4}) == [("", 1, 1), ("own line", 1, 0)]
        assert got({5}) == [("third of three", 1, 0)] and got({8, 9}) == [("", 1, 0)] * 2
        assert [(r["text"], r["n_lines"]) for r in out if r["n"] in (6, 7)] == [(None, 0)] * 2


def brute_spans(docs):
    first = {}
    for i, t in docs:
        for at, _, h in runs_of(t or ""):
            first.setdefault(h, (i, at))
    out = {}
    for i, t in docs:
        cut = [(at, n) for at, n, h in runs_of(t or "") if first[h] != (i, at)]
        out[i] = cut_sentences(t, cut) if t is not None else (None, 0)
    return out


def test_sentences():
    text = "  One two. Three?\nFour  \n\n Five!Six 7.5 x. "
    assert [text[a:b] for a, b in sentences_of(text)] == ["One two.", "Three?", "Four", "Five!Six 7.5 x."]
    assert sentences_of(" \n ") == [] and list(runs_of("Only one sentence here.")) == []


def test_runs_end_by_count_or_words():
    text = " ".join(f"{'w ' * n}{chr(97 + i)}." for i, n in enumerate((2, 3, 4, 20, 5, 1, 1, 1)))
    assert [(i, n) for i, n, _ in runs_of(text)] == [(0, 3), (1, 3), (2, 2), (3, 2), (4, 3)]


def test_spans_against_brute_force(spark):
    random.seed(4)
    say = lambda k: f"{' '.join(f'w{k}{j}' for j in range(1 + k % 17))}."
    docs = []
    for i in range(120):
        s = [say(random.randrange(4000)) for _ in range(random.randrange(1, 15))]
        at = random.randrange(len(s) + 1)
        s[at:at] = [say(5000 + random.randrange(3) * 10 + j) for j in range(5)] if i % 2 else []
        docs.append((i, " ".join(s) if i % 5 else "\n".join(s)))
    docs += [(200, None), (201, ""), (202, " ".join([say(7)] * 12))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_spans(frame).collect()}
    assert got == brute_spans(docs) and sum(n for _, n in got.values()) > 200


def test_passages_go_from_all_but_the_first(spark):
    passage = " ".join(f"Sentence {i} of the shared passage has exactly ten words here." for i in range(6))
    docs = [(i, f"Unique start {i} of a document. {passage} Unique end {i} of it.") for i in range(30)]
    out = {r["doc_id"]: r for r in dedup_spans(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert out[0]["text"] == docs[0][1] and all(out[i]["text"] == f"Unique start {i} of a document. Unique end {i} of it." for i in range(1, 30))


def test_spans_of_odd_tables(spark, odd_docs, no_docs):
    out = {r["doc_id"]: r for r in dedup_spans(odd_docs, keep=("id", "h")).collect()}
    assert len(out) == 11 and out[1]["text"] == "" and out[1]["n_removed"] == 3 and out[3]["text"] is None
    assert out[0]["n_removed"] == 0 and out[2]["n_removed"] == 2 and out[6]["n_removed"] == 0
    assert dedup_spans(no_docs).count() == 0
    assert dedup_spans(odd_docs.union(odd_docs)).count() == 22


def test_lines_by_shuffles_alone(spark, monkeypatch):
    from spanframe.llm import _base

    monkeypatch.setattr(_base, "HEAVY", 5)  # and the common line's rows by a broadcast
    monkeypatch.setattr(_base, "HEAVY_KEYS", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = [(i, "\n".join(["one common line", f"line number {i}", f"own words {i * 7919} here"])) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    try:
        assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in dedup_lines(frame).collect()} == brute_lines(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def brute_units(text):
    """(start, end, words, sentence), character by character, for texts of Latin words and of 。"""
    sentences, now = [], ""
    for i, c in enumerate(text):
        now += c
        if c in "\n。" or (c in ".!?" and text[i + 1 : i + 2].isspace()):
            sentences.append(now)
            now = ""
    out, at, k = [], 0, 0
    for s in [*sentences, now]:
        words, i = [], 0
        while i < len(s):
            n = 1
            while not s[i].isspace() and i + n < len(s) and not s[i + n].isspace() and (s[i] < " " or n < 2):
                n += 1
            words += [] if s[i].isspace() else [(at + i, at + i + n)]
            i += n
        if not words:
            at += len(s)
            continue
        h = [xxhash.xxh64_intdigest(text[a:b]) for a, b in words]
        least = lambda i: all(h[i] < x for x in h[max(0, i - 6) : i]) and all(h[i] <= x for x in h[i + 1 : i + 7])
        starts = [i for i in range(len(words)) if i == 0 or (len(words) > 25 and least(i))]
        while wide := [(i, j) for i, j in zip(starts, [*starts[1:], len(words)], strict=True) if j - i > 25]:
            starts = sorted(starts + [min(range(i + 6, j - 6), key=lambda x: (h[x], x)) for i, j in wide])
        out += [(words[i][0], words[j - 1][1], j - i, k) for i, j in zip(starts, [*starts[1:], len(words)], strict=True)]
        k += bool(words)
        at += len(s)
    return out


def brute_all_runs(docs):
    """Every run of consecutive units, of any length, by its words."""
    first, cut = {}, {i: set() for i, _ in docs}
    for i, t in docs:
        units = brute_units(t)
        said = [tuple(t[a:b].split()) for a, b, _, _ in units]
        for at in range(len(units)):
            for end in range(at + 2, len(units) + 1):
                n = sum(u[2] for u in units[at:end])
                if (n >= 25 or (units[end - 1][3] - units[at][3] >= 2 and n >= 10)) and first.setdefault(tuple(said[at:end]), (i, at)) != (i, at):
                    cut[i].update(range(at, end))
    out = {}
    for i, t in docs:
        units, left, at = brute_units(t), "", 0
        for u in sorted(cut[i]):
            left += t[at : units[u][0]]
            at = units[u + 1][0] if u + 1 < len(units) else len(t)
        out[i] = (left + t[at:], len({units[u][3] for u in cut[i]}))
    return out


def test_every_run_of_any_length(spark):
    random.seed(11)
    sizes = [1, 2, 3, 5, 9, 14, 24, 25, 26, 40, 60, 101]
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(sizes[k % 12])) + random.Random(k).choice([".", "!", "?", "\n"])
    east = lambda k: "".join(chr(0x4E00 + random.Random(k * 99 + j).randrange(5000)) for j in range(1 + k % 120)) + "。"
    docs = []
    for i in range(90):
        s = [say(random.randrange(9000)) for _ in range(random.randrange(1, 7))]
        for _ in range(random.randrange(3)):
            at, k, n = random.randrange(len(s) + 1), random.randrange(0, 50), random.randrange(1, 6)
            s[at:at] = [say(20_000 + k + j) for j in range(n)]
        docs.append((i, " ".join(s)))
    docs += [(100 + i, "".join(east(random.randrange(30) + j) for j in range(random.randrange(1, 5)))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_spans(frame, every=True).collect()}
    assert got == brute_all_runs(docs) and sum(n for _, n in got.values()) > 100


def test_runs_that_neighbours_hid(spark):
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    long, bare = f"{words('l', 60)}.", words("b", 101)
    passage = f"{words('p', 13)}. {words('q', 13)}. {words('r', 3)}."
    docs = [(0, f"Before it. {long} After it."), (1, f"Edited before. {long} Other after."), (2, bare), (3, bare), (4, f"{passage} Some end here."), (5, f"{passage} Another end there.")]
    docs += [(6, "これは長い文章です" * 8 + "。"), (7, "これは長い文章です" * 8 + "。")]
    out = {r["doc_id"]: r["text"] for r in dedup_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), every=True).collect()}
    assert out[1] == "Edited before. Other after." and out[3] == "" and out[5] == "Another end there." and out[7] == ""
    assert all(out[i] == docs[i][1] for i in (0, 2, 4))


def test_equal_rows_lose_all_runs_but_the_first(spark, monkeypatch):
    from spanframe.llm import _base

    passage = " ".join(f"Sentence {i} of this text has exactly ten words here." for i in range(4))
    docs = [(None, passage), (None, passage), (None, passage), (3, f"{passage} Own end."), (3, f"{passage} Own end."), (4, "One sentence only."), (4, "One sentence only."), (None, None), (None, None)]
    frame = spark.createDataFrame([(*d, i, "z") for i, d in enumerate(docs)], "doc_id bigint, text string, n int, n_sentences string")
    for heavy in (50_000, 1):
        monkeypatch.setattr(_base, "HEAVY", heavy)
        monkeypatch.setattr(_base, "HEAVY_KEYS", heavy)
        out = dedup_spans(frame, keep=("n",), every=True).collect()
        assert sorted(r["n"] for r in out) == list(range(9))
        got = lambda ids: sorted((r["text"] or "", r["n_sentences"], r["n_removed"]) for r in out if r["n"] in ids)
        # ids before none: the first of the two rows of id 3 keeps the passage
        assert got({3, 4}) == [("", 5, 5), (f"{passage} Own end.", 5, 0)] and got({0, 1, 2}) == [("", 4, 4)] * 3
        assert got({5, 6}) == [("One sentence only.", 1, 0)] * 2 and got({7, 8}) == [("", 0, 0)] * 2


def test_passages_inside_of_other_long_sentences():
    rng, found = random.Random(5), 0
    say = lambda name, n: " ".join(f"{name}{rng.randrange(10**9)}" for _ in range(n))
    for _ in range(100):
        passage = say("p", 60)
        a, b = (f"{say(x, rng.randrange(1, 60))} {passage} {say(x, rng.randrange(1, 60))}" for x in "ab")
        shared = {h for _, _, h in all_runs_of(a)} & {h for _, _, h in all_runs_of(b)}
        found += bool(shared)
    assert found >= 95
    same = "word " * 5000
    assert [n for _, _, n, _ in units_of(same)] and max(n for _, _, n, _ in units_of(same)) <= 25 and sum(n for _, _, n, _ in units_of(same)) == 5000


def test_a_million_blanks_take_no_time():
    import time

    began = time.perf_counter()
    for blank in (" ", "\n", "\t \n"):
        assert [t for t in sentences_of("One." + blank * 1_000_000 + "Two.") if t[1] - t[0] != 4] == []
    assert time.perf_counter() - began < 5


def test_spans_of_rows_that_share_an_id_or_have_none(spark, monkeypatch):
    from spanframe.llm import span_dedup

    monkeypatch.setattr(span_dedup, "HEAVY", -1)  # every run of the sample is frequent
    monkeypatch.setattr(span_dedup, "SAMPLE", 0.9)
    passage = " ".join(f"Sentence {i} of the shared passage has exactly ten words here." for i in range(6))
    docs = [(7, f"{passage} Ends in one way."), (7, f"{passage} Ends in another way, too."), (None, f"Nobody wrote this. {passage}"), (3, "x"), (3, "x")]
    out = [r["text"] for r in dedup_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), every=True).collect()]
    assert sum(passage in t for t in out) == 1 and "Nobody wrote this. " in out and out.count("x") == 2 and len(out) == 5
