"""Text helpers against Python, files of any size, scoring diagnostics, policies and events on odd tables, SQL table functions."""

from __future__ import annotations

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spanframe.functions import columns as fn
from spanframe.functions.sql import register_functions
from spanframe.operators import matching as mt
from spanframe.operators import planning as pl
from spanframe.operators import policy as po
from spanframe.operators import sampling as sm
from spanframe.operators import stats as st
from spanframe.sources import readers as rd


def first_object(text):
    """The reference form: a decoder tried at each brace."""
    decoder = json.JSONDecoder()
    for i, c in enumerate(text or ""):
        if c == "{":
            try:
                return text[i : i + decoder.raw_decode(text[i:])[1]]
            except json.JSONDecodeError:
                continue
    return None


def test_json_objects_against_a_decoder(spark):
    rng = random.Random(8)
    texts = ['{"k":{"j":"}"}}', 'so {"a": "{"} or', '5" wide {"a": "\\"}"} x', '{"a": {"b": "c\\\\"}}', "{'a': 1} {\"b\": [1, {\"c\": \"]}\"}]}", '{"a": 1', '}{"a": {}}', "{}", '{"a": "x" {"b": 2}', None, ""]
    parts = ["{", "}", '"', "\\", '"k"', ":", "1", " ", '{"a": 1}', '{"b": "}"}', "text", ",", '"{"']
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r["n"]: r["o"] for r in frame.select("n", fn.first_json_object(F.col("t")).alias("o")).collect()}
    assert {n: got[n] for n in got if got[n] != first_object(texts[n])} == {}
    long = '{"a": "' + "x" * 50_000 + '\\"}" }'
    assert spark.createDataFrame([(f"noise {long}",)], "t string").select(fn.first_json_object(F.col("t"))).first()[0] == long


def test_redaction(spark):
    cases = {
        "C:\\Users\\bob smith\\x.txt\nnext": "[path]\nnext", "see \\\\server\\share\\f": "see [path]", "in /tmp/a b": "in [path]", "/var/log/x": "[path]", "(/mnt/d)": "([path]", "/private/x\r\ny": "[path]\r\ny", "and /Home/me": "and [path]",
        "key sk-abcdefghij1 end": "key [redacted] end", "sk_live_0123456789": "[redacted]", "lsv2_pt_0123456789ab": "[redacted]", "ls__abcdefghij": "[redacted]", "sk-short": "sk-short", "task-abcdefghijkl": "task-abcdefghijkl",
        "http://x/y and a/tmp/z": "http://x/y and a/tmp/z", "password = hunter2": "password=[redacted]", "plain": "plain",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "n int, t string")
    got = {r["n"]: r["o"] for r in frame.select("n", fn.redact(F.col("t")).alias("o")).collect()}
    assert list(got[i] for i in range(len(cases))) == list(cases.values())
    m = spark.createDataFrame([({"Stage": "x /tmp/y", "error": "all of it", "path": "p"},)], "m map<string,string>").select(fn.redact_map(F.col("m"), ["stage", "error"]).alias("m")).first()["m"]
    assert m == {"Stage": "x [path]", "error": "[error]"}


def test_fingerprints_of_any_size(spark, tmp_path):
    data = {f"f {i}.bin": random.Random(i).randbytes(n) for i, n in enumerate((1, 99, 100, 101, 5000))}
    for name, b in data.items():
        (tmp_path / name).write_bytes(b)
    want = {name: hashlib.sha256(b).hexdigest() for name, b in data.items()}
    for whole in (10_000, 100, 0):
        got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["sha256"], r["length"]) for r in rd.fingerprint_files(spark, str(tmp_path), whole=whole, piece=64).collect()}
        assert got == {n: (h, len(data[n])) for n, h in want.items()}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(3 << 30)  # sparse
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range((3 << 30) >> 24):
        digest.update(zeros)
    assert [(r["length"], r["sha256"]) for r in rd.fingerprint_files(spark, str(tmp_path)).collect()] == [(3 << 30, digest.hexdigest())]


def test_scoring_diagnostics(spark):
    frame = spark.range(100).withColumn("part", F.col("id") % 2).repartitionByRange(2, "part")

    def half(b):
        if b.column("part")[0].as_py() == 1:
            raise LookupError("no")
        import pyarrow.compute as pc

        return pc.divide(pc.cast(b.column("id"), "double"), 200.0)

    seen = Observation("s")
    out = pl.score(frame, half, observation=seen).collect()
    assert {r["error"] for r in out if r["part"] == 1} == {"LookupError"} and all(r["error"] is None and r["probability"] == r["id"] / 200 for r in out if r["part"] == 0)
    assert seen.get == {"batches": 2, "failed_batches": 1, "rows": 100, "scored": 50, "included": 50}
    import pyarrow as pa

    for bad in (lambda b: pa.array([0.5]), lambda b: pa.array([float("nan")] * b.num_rows), lambda b: pa.array([None] * b.num_rows, pa.float64())):
        assert {(r["probability"], r["included"], r["error"]) for r in pl.score(frame, bad).collect()} == {(1.0, True, "ValueError")}


def brute_policies(rows, policies):
    return {(a, b): sum(1 for x, y in rows if (x is not None and x >= a) or (y is not None and y >= b)) for a, b in policies}


def test_policies_by_running_sums(spark):
    rng = random.Random(2)
    draw = lambda: rng.choice([None, *[i / 10 for i in range(11)]])
    rows = [(draw(), draw()) for _ in range(300)]
    policies = [(rng.randrange(-1, 13) / 10, rng.randrange(-1, 13) / 10) for _ in range(60)]
    frame = spark.createDataFrame(rows, "a double, b double")
    grid = spark.createDataFrame(policies, "t_a double, t_b double")
    got = {(r["t_a"], r["t_b"]): (r["passing"], r["total"]) for r in po.passing_counts(frame, grid, "a", "b").collect()}
    assert got == {k: (n, 300) for k, n in brute_policies(rows, policies).items()}
    none = po.passing_counts(frame.limit(0), grid, "a", "b").collect()
    assert len(none) == len(set(policies)) and all((r["passing"], r["total"]) == (0, 0) for r in none)
    plan = po.passing_counts(frame, grid, "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner\n") <= 3  # the only joins without a key are those with one row


def test_a_million_policies(spark):
    samples = spark.range(20_000).selectExpr("(id * 7919) % 1000 / 1000.0D as a", "(id * 104729) % 1000 / 1000.0D as b")
    grid = spark.range(1_000_000).selectExpr("id div 1000 / 1000.0D as t_a", "id % 1000 / 1000.0D as t_b")
    out = po.passing_counts(samples, grid, "a", "b")
    x = np.arange(20_000)
    a, b = x * 7919 % 1000 / 1000, x * 104729 % 1000 / 1000
    assert out.count() == 1_000_000
    for i, j in ((0, 0), (999, 999), (500, 250), (1, 998)):
        r = out.where((F.col("t_a") == i / 1000) & (F.col("t_b") == j / 1000)).first()
        assert r["passing"] == int(((a >= i / 1000) | (b >= j / 1000)).sum())


def test_thresholds_without_samples_miss_everything(spark):
    samples = spark.createDataFrame([], "media_id bigint, sample_id bigint, ts_us bigint, a double, b double")
    truth = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 20, 30)], "media_id bigint, interval_id bigint, start_us bigint, end_us bigint")
    policies = spark.createDataFrame([(0.5, 0.5), (0.1, 0.9)], "t_a double, t_b double")
    out = po.evaluate_thresholds(samples, truth, policies, tol=1, width=10).collect()
    assert len(out) == 2 and all((r["detected"], r["n_intervals"], r["recall"], r["n_samples"]) == (0, 2, 0.0, 0) for r in out)


EVENT = "media_id bigint, interval_id bigint, start_us bigint, end_us bigint, category string"


def test_repeated_events_are_events_of_their_own(spark):
    media = spark.createDataFrame([(1, 1000)], "media_id bigint, duration_us bigint")
    far = spark.createDataFrame([(1, 900, 950)], "media_id bigint, start_us bigint, end_us bigint")
    p = spark.createDataFrame([(1, 7, 0, 10, "a"), (1, 7, 0, 10, "a")], EVENT)
    t = spark.createDataFrame([(1, 1, 0, 10, "a")], EVENT)
    for cut in (None, far):
        r = mt.evaluate_media(p, t, media, cut, thresholds=(0.5,), width=50).first()
        assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 0)
        r = mt.evaluate_media(t, p, media, cut, thresholds=(0.5,), width=50).first()
        assert (r["tp"], r["fp"], r["fn"]) == (1, 0, 1)


def test_no_count_is_negative_and_far_exclusions_change_nothing(spark):
    rng = np.random.default_rng(4)
    rows = lambda: [(int(m), int(i), int(s), int(s + w), "ab"[int(c)]) for m, i, s, w, c in zip(rng.integers(0, 5, 60), rng.integers(0, 6, 60), rng.integers(0, 60, 60), rng.integers(1, 9, 60), rng.integers(0, 2, 60), strict=True)]
    p, t = (spark.createDataFrame(rows(), EVENT) for _ in range(2))
    media = spark.createDataFrame([(m, 1000) for m in range(5)], "media_id bigint, duration_us bigint")
    far = spark.createDataFrame([(m, 990, 999) for m in range(5)], "media_id bigint, start_us bigint, end_us bigint")
    counts = ("tp", "fp", "fn", "start_n", "start_bias_us", "target_us", "predicted_us", "covered_us")
    table = lambda cut: {(r["media_id"], r["category"], r["threshold"]): tuple(r[c] for c in counts) for r in mt.evaluate_media(p, t, media, cut, width=20).collect()}
    plain = table(None)
    assert plain == table(far) and all(min(v[:4]) >= 0 for v in plain.values()) and len(plain) > 10


def test_contested_pairs_are_solved_apart():
    ps, ts = np.array([0, 1, 1, 2, 3, 4]), np.array([0, 0, 1, 2, 3, 3])
    assert sorted(map(tuple, mt._connected(ps, ts))) == [(0, 1, 2), (3,), (4, 5)]
    assert mt._connected(np.array([], int), np.array([], int)) == []


def test_invariants_name_what_is_broken(spark):
    schema = "media_id bigint, sample_id bigint, ts_us bigint, duration_us bigint, scene boolean, disposition string, duplicate_of_us bigint, own int"
    rows = [(1, 0, 0, 100, False, "representative", None, 0), (1, 1, 20, 100, False, "static_suppressed", 0, 0), (1, 2, 60, 100, False, "representative", None, 1), (1, 3, 90, 100, False, "black", None, 1)]
    media = spark.createDataFrame([(1, 100)], "media_id bigint, duration_us bigint")
    chunks = sm.plan_chunks(media, core=50, overlap=10)

    def broken(change=None, chunks=chunks, gap=40, told=None):
        rows2 = [tuple(r) for r in rows]
        for i, column, value in change or ():
            at = [c.split()[0] for c in schema.split(", ")].index(column)
            rows2[i] = rows2[i][:at] + (value,) + rows2[i][at + 1 :]
        out = sm.check_invariants(spark.createDataFrame(rows2, schema), core=50, gap=gap, tie=("sample_id",), arrival="sample_id", chunks=chunks, recorded="own", static=30, statistics=told)
        return {r["name"] for r in out.collect() if not r["passed"]}

    assert broken() == set()
    assert broken([(2, "ts_us", 10)]) >= {"sorted"} and broken([(3, "ts_us", 101)]) >= {"in_range"} and broken([(2, "own", 0)]) == {"owned"}
    assert broken(gap=39) == {"longest_gap"}
    assert broken([(3, "ts_us", 60), (3, "duration_us", 130)], gap=60) >= {"longest_gap"}
    assert broken([(1, "duplicate_of_us", 60)]) == {"static"} and broken([(1, "scene", True)]) == {"static"} and broken([(1, "duplicate_of_us", None)]) == {"static"} and broken([(1, "duplicate_of_us", 0), (1, "ts_us", 30)]) == {"static"}
    assert broken([(3, "disposition", "odd")]) == {"accounted"} and broken([(0, "disposition", "black"), (2, "disposition", "black"), (1, "disposition", "black")]) == {"not_empty"}
    assert broken(chunks=chunks.where("chunk = 0")) == {"cores"} and broken(chunks=chunks.withColumn("core_start_us", F.col("core_start_us") + 1)) == {"cores"}
    told = spark.createDataFrame([(1, 4, 1, 0, 1, 2)], "media_id bigint, n bigint, n_black bigint, n_duplicates bigint, n_static bigint, n_representatives bigint")
    assert broken(told=told) == set() and broken(told=told.withColumn("n", F.lit(5))) == {"accounted"}


def test_robustness_over_gaps(spark):
    samples = spark.createDataFrame([(1, i, t, 0.9) for i, t in enumerate((1, 12, 24, 33))], "media_id bigint, sample_id bigint, ts_us bigint, a double")
    truth = spark.createDataFrame([(1, 1, 12, 12), (1, 2, 24, 33)], "media_id bigint, interval_id bigint, start_us bigint, end_us bigint")
    out = po.sampling_robustness(samples, truth, settings=[(10, 0), (10, 5), (100, 0), (1000, 999)], t_a=0.5, width=10)
    assert {(r["gap"], r["phase"]): (r["retained"], r["detected"]) for r in out.collect()} == {(10, 0): (4, 2), (10, 5): (3, 2), (100, 0): (1, 0), (1000, 999): (0, 0)}
    worst = po.worst_case(out, 2)
    assert {r["gap"]: (r["robust"], r["first_failing_phase"]) for r in worst.collect()} == {10: (True, None), 100: (False, 0), 1000: (False, 999)}
    assert po.largest_robust_gap(worst).first()["gap"] == 10


def test_bootstrap_equals_the_plain_form(spark):
    groups = [(f"g{i}", i % 4, 5 + i) for i in range(9)]
    frame = spark.createDataFrame(groups, "group_id string, k bigint, n bigint")
    r = st.grouped_bootstrap(frame, ["k", "n"], F.try_divide(F.col("k").cast("double"), F.col("n").cast("double")), resamples=40, seed="s").first()
    values = []
    for x in range(1, 41):
        picks = [groups[int(hashlib.sha256(f"s|{x}|{i}".encode()).hexdigest()[:8], 16) % 9] for i in range(1, 10)]
        values.append(sum(g[1] for g in picks) / sum(g[2] for g in picks))
    assert r["n_resamples"] == 40 and r["low"] == pytest.approx(np.quantile(values, 0.025)) and r["high"] == pytest.approx(np.quantile(values, 0.975))


def test_table_functions(spark):
    register_functions(spark)
    rows = [(k, t, f"{k}{t}") for k, t in itertools.product(("x", "y"), (1, 3, 4, 9, None))]
    spark.createDataFrame(rows, "key string, t bigint, note string").createOrReplaceTempView("tf")
    got = spark.sql("SELECT * FROM min_gap(TABLE(tf), 'key', 't', 3) ORDER BY key, t")
    assert got.columns == ["key", "t", "note"] and [tuple(r) for r in got.collect()] == [(k, t, f"{k}{t}") for k in "xy" for t in (1, 4, 9)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM threshold_grid(TABLE(tf), 'key', 't', 2) ORDER BY key, threshold").collect()] == [(k, v) for k in "xy" for v in (1.0, 9.0)]
    assert [r[0] for r in spark.sql("SELECT phase FROM phase_grid(4L, 3L)").collect()] == sm.phase_grid(4, 3)
    with pytest.raises(AnalysisException, match="no column"):
        spark.sql("SELECT * FROM min_gap(TABLE(tf), 'key', 'nope', 3)").collect()


def test_concepts_in_one_pass(spark):
    rng = np.random.default_rng(3)
    bank = spark.createDataFrame([(c, [float(x) for x in rng.normal(size=6)]) for c in "aabcd"], "concept string, prompt array<double>")
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(30)]
    samples = spark.createDataFrame([*rows, (90, None), (91, [0.0] * 6), (92, [1.0]), (93, [float("nan")] * 6), (94, [None, *[1.0] * 5])], "id bigint, vector array<double>")
    got = {r["id"]: tuple(r)[1:] for r in pl.score_concepts(samples, bank, ["a", "b"], ["d"], ident="id").collect()}
    plain = pl.concept_strategies(pl.concept_scores(samples.where("id < 90"), bank), ["a", "b"], ["d"], ["id"])
    for r in plain.collect():
        assert got[r["id"]] == pytest.approx(tuple(r)[1:])
    assert all(got[i] == (None,) * 5 for i in range(90, 95)) and len(got) == 35
    with pytest.raises(ValueError):
        pl.score_concepts(samples, bank.limit(0), [], [], ident="id")


def test_lexicons_with_and_without_groups(spark):
    rows = [(1, 0, "say abab now"), (1, 1, "xyz"), (2, 0, "Red"), (2, 1, None)]
    segments = spark.createDataFrame(rows, "media_id bigint, start_us bigint, text string")
    for extra in ([], [(9, "rep", 0.95, r"(ab)\1")]):
        lexicon = spark.createDataFrame([(1, "color", 0.9, "red|blue"), (2, "low", 0.2, "x"), *extra], "rank int, category string, confidence double, pattern string")
        got = sorted((r["media_id"], r["start_us"], r["category"]) for r in pl.text_evidence(segments, lexicon, least=0.5, ident=["media_id", "start_us"]).collect())
        assert got == ([(1, 0, "rep")] if extra else []) + [(2, 0, "color")]
    assert pl.text_evidence(segments, lexicon.limit(0), least=0.5, ident=["media_id", "start_us"]).count() == 0
