"""Streams in several micro-batches, with failures and retries, against plain models."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from spanframe.operators import intervals as iv
from spanframe.streaming import sinks as st
from spanframe.streaming import streams as sx

SAMPLE = "media_id BIGINT, sample_id BIGINT, ts_us BIGINT"
S = 1_000_000


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def run(spark, path, schema, make, each, check, mode="append", name=None):
    rows = make(sx.stream_samples(spark, path, schema, delay="0 seconds", files=1))
    writer = rows.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True)
    query = (writer.queryName(name) if name else writer).start()
    query.awaitTermination(120)
    return query


class Tracker:
    """One media's reports, one by one."""

    def __init__(self):
        self.anchor, self.out = None, []

    def take(self, wall, kind, position, rate):
        if kind == "interrupt":
            self.anchor = None
        elif kind == "resume":
            if self.anchor:
                self.anchor = (self.anchor[0], wall, self.anchor[2])
        else:
            old, self.anchor = self.anchor, (position, wall, rate)
            if old and old[2] == rate and position > old[0] and position - old[0] <= old[2] * (wall - old[1]) + 250_000:
                self.out.append((old[0], position))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_played_ranges_against_a_tracker(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, want, path = [], [], str(tmp_path / "in")
    for m in (1, 2, 3):
        wall = position = S * 10
        tracker = Tracker()
        for seq in range(120):
            wall += rng.choice([0, 1, S // 4, S // 2, S])
            kind = rng.choices(["observe", "interrupt", "resume"], [8, 1, 1])[0]
            rate = rng.choice([1.0, 1.0, 1.0, 2.0])
            position += rng.choice([0, S // 4, S // 2, S, S * 2, -S, S * 60])
            tracker.take(wall, kind, position, rate)
            rows.append((m, wall, seq, kind, position if kind == "observe" else None, rate if kind == "observe" else None, wall))
        want += [(m, *r) for r in tracker.out]
    assert len(want) > 20
    schema = "media_id BIGINT, wall_us BIGINT, seq BIGINT, kind STRING, position_us BIGINT, rate DOUBLE, ts_us BIGINT"
    whole = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, sx.played_ranges(whole).collect())) == sorted(want)
    ends = sorted(r[1] for r in rows)
    cuts = [0, *(ends[len(ends) * i // 5] for i in range(1, 5)), ends[-1] + 1]
    for a, b in zip(cuts, cuts[1:], strict=False):
        feed(spark, path, rng.sample(part := [r for r in rows if a <= r[1] < b], len(part)), schema)
    out = str(tmp_path / "out")
    run(spark, path, schema, lambda s: sx.track_played(s, forget="1 day"), st.table_sink(out), str(tmp_path / "check"))
    got = st.read_sink(spark, out, "media_id BIGINT, start_us BIGINT, end_us BIGINT")
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(want) and got.select("batch").distinct().count() > 2
    covered = {r["media_id"]: r["total_us"] for r in iv.total_duration(got.drop("batch"), overlap_aware=True).collect()}
    for m in covered:
        seen = set()
        for _, a, b in (r for r in want if r[0] == m):
            seen |= set(range(a // (S // 4), b // (S // 4)))
        assert covered[m] == len(seen) * (S // 4)


def test_a_silent_media_is_forgotten(spark, tmp_path):
    schema = "media_id BIGINT, wall_us BIGINT, seq BIGINT, kind STRING, position_us BIGINT, rate DOUBLE, ts_us BIGINT"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    report = lambda m, wall, seq, position: (m, wall * S, seq, "observe", position * S, 1.0, wall * S)
    feed(spark, path, [report(1, 10, 0, 1), report(1, 11, 1, 2)], schema)
    feed(spark, path, [report(2, 500, 0, 1)], schema)
    feed(spark, path, [report(2, 501, 1, 2), report(1, 501, 2, 400)], schema)
    run(spark, path, schema, lambda s: sx.track_played(s, forget="60 seconds"), st.table_sink(out), str(tmp_path / "check"))
    got = sorted(map(tuple, st.read_sink(spark, out, "media_id BIGINT, start_us BIGINT, end_us BIGINT").drop("batch").collect()))
    assert got == [(1, S, 2 * S), (2, S, 2 * S)]


def test_fan_out_isolates_and_records(spark, tmp_path):
    frame = spark.range(3)
    good = str(tmp_path / "good")
    calls = []

    def bad(df, n):
        calls.append(n)
        raise ValueError("sink is down")

    each = st.fan_out({"bad": bad, "good": st.table_sink(good)}, str(tmp_path / "ledger"), attempts=2)
    each(frame, 4)
    each(frame, 4)  # the batch comes again
    assert calls == [4, 4, 4, 4] and st.read_sink(spark, good, "id BIGINT").count() == 3
    assert sorted(tuple(r) for r in st.read_failures(spark, str(tmp_path / "ledger")).collect()) == [("bad", i, "ValueError: sink is down", 4) for i in (1, 2)]
    assert st.read_failures(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_batch_is_retried_for_the_failed_sink_alone(spark, tmp_path):
    path, out = str(tmp_path / "in"), {n: str(tmp_path / n) for n in ("a", "b")}
    for i in range(3):
        feed(spark, path, [(1, i, (i + 1) * S)], SAMPLE)
    state = {"down": True, "a": []}

    def first(df, n):
        state["a"].append(n)
        st.table_sink(out["a"])(df, n)

    def second(df, n):
        st.table_sink(out["b"])(df, n)  # written, and yet failed
        if n == 1 and state["down"]:
            raise OSError("gone")

    each = st.fan_out({"a": first, "b": second}, str(tmp_path / "ledger"), strict=True)
    with pytest.raises(Exception, match="batch 1 failed for b"):
        run(spark, path, SAMPLE, lambda s: s.drop("ts"), each, str(tmp_path / "check"))
    state["down"] = False
    run(spark, path, SAMPLE, lambda s: s.drop("ts"), each, str(tmp_path / "check"))
    assert state["a"] == [0, 1, 2]
    for n in out:
        assert sorted(r["sample_id"] for r in st.read_sink(spark, out[n], SAMPLE).collect()) == [0, 1, 2]


def test_upserts_of_update_mode(spark, tmp_path):
    schema = "run_id BIGINT, stage STRING, done BIGINT, total BIGINT, seq BIGINT, failed BOOLEAN, ts_us BIGINT"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i % 3, "ab"[i % 2], i * 10, 1000, i, i % 7 == 0, (i + 1) * S) for i in range(40)]
    for k in range(4):
        feed(spark, path, rows[k * 10 : k * 10 + 10], schema)
    run(spark, path, schema, sx.progress_monitor, st.table_sink(out), str(tmp_path / "check"), mode="update")
    key = ["run_id", "stage"]
    got = st.read_latest(spark, out, "run_id BIGINT, stage STRING, done BIGINT, total BIGINT, n_failed BIGINT", key)
    want = sx.progress_monitor(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    last = spark.createDataFrame(spark.read.schema(got.schema).parquet(f"{out}/batch=3").collect(), got.schema)
    st.table_sink(out)(last, 3)  # the last batch comes again
    again = st.read_latest(spark, out, "run_id BIGINT, stage STRING, done BIGINT, total BIGINT, n_failed BIGINT", key)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dead_letters_once(spark, tmp_path):
    good, dead, marks = (str(tmp_path / n) for n in ("good", "dead", "marks"))
    each = st.late_audit(st.table_sink(good), st.table_sink(dead), marks, delay_us=10)
    rows = [[100, 50, None], [90, 91, 200], [189, 190, 191, 1], [], [191, 190]]
    for n, part in enumerate(rows):
        frame = spark.createDataFrame([(n, i, t) for i, t in enumerate(part)], SAMPLE)
        each(frame, n)
        if n == 2:
            each(frame, n)  # retried
    got = lambda p: sorted((r["media_id"], r["ts_us"] or 0) for r in st.read_sink(spark, p, SAMPLE).collect())
    assert got(dead) == [(0, 0), (1, 90), (2, 1), (2, 189), (2, 190), (4, 190)]
    assert got(good) == [(0, 50), (0, 100), (1, 91), (1, 200), (2, 191), (4, 191)]
    seen = spark.read.parquet(f"{dead}/batch=2").select("watermark_us").distinct().collect()
    assert [r[0] for r in seen] == [190]


def test_late_rows_of_a_stream_hold_all_that_spark_drops(spark, tmp_path):
    path, good, dead = (str(tmp_path / n) for n in ("in", "good", "dead"))
    for part in ([10, 12], [5, 30], [29, 31, 2]):
        feed(spark, path, [(1, t, t * S) for t in part], SAMPLE)
    run(spark, path, SAMPLE, lambda s: s.drop("ts"), st.late_audit(st.table_sink(good), st.table_sink(dead), str(tmp_path / "marks"), delay_us=0), str(tmp_path / "check"))
    kept = str(tmp_path / "kept")
    run(spark, path, SAMPLE, lambda s: sx.dedupe_replays(s).drop("ts"), st.table_sink(kept), str(tmp_path / "check2"))
    ids = lambda p: sorted(r["sample_id"] for r in st.read_sink(spark, p, SAMPLE).collect())
    # Spark's own filter is a batch behind, so it drops some of the late rows, and no other
    assert ids(good) == [10, 12, 30, 31] and ids(dead) == [2, 5, 29] and {2} <= set(ids(dead)) - set(ids(kept)) and not set(ids(good)) - set(ids(kept))


def test_listener_counts_rows_and_names_failures(spark, tmp_path):
    listener = st.ProgressListener()
    spark.streams.addListener(listener)
    try:
        path = str(tmp_path / "in")
        for i in range(3):
            feed(spark, path, [(1, i, (i + 1) * S), (2, i, (i + 1) * S)], SAMPLE)
        run(spark, path, SAMPLE, lambda s: s.drop("ts"), st.table_sink(str(tmp_path / "out")), str(tmp_path / "c1"), name="works")

        def down(df, n):
            raise OSError("disk full")

        with pytest.raises(Exception, match="disk full"):
            run(spark, path, SAMPLE, lambda s: s.drop("ts"), down, str(tmp_path / "c2"), name="fails")
        until = time.time() + 30
        while time.time() < until and not all(listener.seen.get(n, {}).get("ended") for n in ("works", "fails")):
            time.sleep(0.2)
        works, fails = listener.seen["works"], listener.seen["fails"]
        assert (works["batches"], works["rows"], works["failure"]) == (3, 6, None) and works["rows_per_second"] > 0
        assert "disk full" in fails["failure"]
    finally:
        spark.streams.removeListener(listener)


def test_windows_close_by_watermark(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([1, 5], [11, 12], [35]):
        feed(spark, path, [(1, t, t * S) for t in part], SAMPLE)
    run(spark, path, SAMPLE, lambda s: sx.routing_windows(s, "10 seconds", F.col("sample_id") % 2 == 1), st.table_sink(out), str(tmp_path / "check"))
    got = st.read_sink(spark, out, "media_id BIGINT, start_us BIGINT, n_observed BIGINT, n_routed BIGINT, n_skipped BIGINT, digest STRING").orderBy("start_us").collect()
    import hashlib

    assert [(r["start_us"] // S, r["n_observed"], r["n_routed"], r["n_skipped"]) for r in got] == [(0, 2, 2, 0), (10, 2, 1, 1)]
    assert got[0]["digest"] == hashlib.sha256(b"1000000\n5000000").hexdigest()
