"""Summaries of model verdicts on small tables with every odd case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanframe.operators import stats as st
from spanframe.operators import verdicts as vs

ANSWER = "variant string, media_id bigint, event_id bigint, category string, answer string, seconds double, tokens bigint"


@pytest.fixture(scope="module")
def tables(spark):
    intervals = spark.createDataFrame([(1, 1, 0, 10, "red"), (1, 2, 20, 30, "blue"), (2, 3, 0, 5, "red")], "media_id bigint, interval_id bigint, start_us bigint, end_us bigint, category string")
    events = spark.createDataFrame([(1, 7, 10, 20), (1, 8, 100, 110), (2, 9, 6, 9)], "media_id bigint, event_id bigint, start_us bigint, end_us bigint")
    return vs.interval_pairs(events, intervals, width=50), intervals.select("media_id", "interval_id", "category")


def test_pairs_hold_edges(tables):
    assert sorted(map(tuple, tables[0].collect())) == [(1, 1, 7), (1, 2, 7)]


def test_binary(spark, tables):
    rows = [("a", 1, 7, "red", "yes", 1.0, 3), ("a", 1, 7, "blue", "no", 2.0, 3), ("a", 2, 9, "red", None, 3.0, 3), ("b", 1, 7, "red", "no", 1.0, 1), ("c", 1, 8, "blue", "yes", 1.0, 1)]
    answers = spark.createDataFrame(rows, ANSWER)
    out = {r["variant"]: r for r in vs.binary_summary(answers, *tables, ["variant"]).collect()}
    a = out["a"]
    assert (a["n_events"], a["n_requests"], a["n_yes"], a["n_no"], a["n_unverified"], a["valid_rate"], a["p50_s"], a["tokens"]) == (2, 3, 1, 1, 1, pytest.approx(2 / 3), 2.0, 9)
    # the event overlaps both intervals: both are detected, one with its category
    assert (a["n_intervals"], a["n_detected"], a["n_category_detected"]) == (3, 2, 1)
    assert [(out[v]["n_detected"], out[v]["recall"]) for v in "bc"] == [(0, 0.0), (0, 0.0)]
    per = {(r["variant"], r["category"]): (r["n_yes"], r["n_intervals"], r["n_detected"], r["recall"]) for r in vs.binary_by_category(answers.union(answers.limit(1).withColumn("category", F.lit("green"))), *tables, ["variant"]).collect()}
    assert per["a", "red"] == (1, 2, 1, 0.5) and per["a", "blue"] == (0, 1, 0, 0.0) and per["a", "green"] == (1, 0, 0, None)
    assert vs.binary_summary(answers.limit(0), *tables, ["variant"]).count() == 0


def test_bitmasks(spark, tables):
    masks = spark.createDataFrame([("a", 1, 7, ["blue"], 1.0), ("a", 1, 8, [], 2.0), ("a", 2, 9, None, 3.0), ("b", 1, 7, [], 1.0)], "variant string, media_id bigint, event_id bigint, categories array<string>, seconds double")
    answers = spark.createDataFrame([(1, 7, "blue", "no"), (1, 7, "red", "no"), (1, 8, "red", None), (2, 9, "red", "yes")], "media_id bigint, event_id bigint, category string, answer string")
    out = {r["variant"]: r for r in vs.bitmask_summary(masks, *tables, ["variant"], answers).collect()}
    a = out["a"]
    assert (a["n_events"], a["n_valid"], a["n_with"], a["n_without"], a["n_unverified"]) == (3, 2, 1, 1, 1)
    assert (a["n_detected"], a["n_category_detected"], a["comparable"], a["disagreements"]) == (2, 1, 2, 1)
    assert (out["b"]["n_detected"], out["b"]["comparable"], out["b"]["disagreements"]) == (0, 2, 0)


def test_quality(spark):
    schema = "status string, reason string, json_valid boolean, schema_valid boolean, n_frames bigint, overlaps boolean, retried boolean, recovered boolean"
    rows = [("verified_unsafe", None, True, True, 3, True, False, None), ("unverified", "schema", True, False, 2, None, True, False), ("verified_safe", None, True, True, 1, False, True, True), (None, None, None, None, 4, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    r = vs.quality_summary(frame).first()
    assert (r["n_events"], r["n_frames"], r["n_resolved"], r["n_unresolved"], r["n_unsafe"], r["n_safe"], r["n_unverified"]) == (4, 10, 3, 1, 1, 1, 2)
    assert (r["json_rate"], r["schema_rate"], r["n_retried"], r["n_recovered"], r["n_unlabelled"], r["unlabelled_safe"], r["unlabelled_unverified"]) == (1.0, pytest.approx(2 / 3), 2, 1, 3, 1, 2)
    assert {(x["reason"], x["n"]) for x in vs.unverified_reasons(frame).collect()} == {("schema", 1), ("unresolved_frame_reconstruction", 1)}
    none = vs.quality_summary(frame.where("status is null")).first()
    assert none["json_rate"] is None and none["n_unverified"] == 1


def test_small_operators(spark):
    rows = spark.range(10).selectExpr("id % 2 as media_id", "id as ts_us", "cast(id as double) as s")
    r = vs.batch_occupancy(rows, ["media_id"], 4).where("media_id = 0").first()
    assert (r["n_batches"], r["n_full"], r["n_partial"], r["last_size"], r["occupancy"]) == (2, 1, 1, 1, 0.625)
    assert vs.batch_occupancy(rows, ["media_id"], 5).where("media_id = 1").first()["n_partial"] == 0
    one = spark.range(1)
    assert vs.gate(rows, one, F.lit(True)).count() == 10 and vs.gate(rows, one, F.lit(None).cast("boolean")).count() == 0 and vs.gate(rows, one.limit(0), F.lit(True)).count() == 0
    assert {r["media_id"]: r["ts_us"] for r in vs.first_at_or_after(rows, 9).collect()} == {0: None, 1: 9}
    paths = spark.createDataFrame([("/A", 5, 1), ("/a", 3, 2), ("/b", 9, 3)], "path string, age bigint, id bigint")
    assert sorted(map(tuple, vs.oldest_by_path(paths, "path", "age", "id").collect())) == [("/a", 2), ("/b", 3)]
    found = vs.results_lookup(spark.createDataFrame([(1, None), (2, 0.5), (3, 0.9)], "id bigint, c double"), where=F.lit(True), order=[F.col("c").desc()], least=("c", 0.5))
    assert [r["id"] for r in found.collect()] == [3, 2]


def test_reports_withhold_what_is_not_verified(spark):
    frame = spark.createDataFrame([(1, 0.5, 0.4, 3, True, 2), (2, 0.5, 0.4, 3, False, 0), (3, 0.5, 0.4, 3, None, None)], "id bigint, precision double, recall_low double, n_alerts bigint, done boolean, positives bigint")
    out = {r["id"]: r for r in st.score_report(frame, F.col("done"), positives=F.col("positives")).collect()}
    assert (out[1]["precision"], out[1]["withheld"], out[1]["scope"]) == (0.5, None, None)
    for i in (2, 3):
        assert out[i]["precision"] is None and out[i]["recall_low"] is None and out[i]["n_alerts"] == 3 and out[i]["withheld"] and out[i]["scope"]
