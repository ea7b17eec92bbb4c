from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.functions import columns as fn
from spanframe.operators import matching as mt
from spanframe.operators import planning as pl
from spanframe.operators import sampling as sm
from spanframe.operators import stats as st
from spanframe.sources import readers as rd
from spanframe.sources import sinks
from spanframe.streaming import streams as sx

S = 1_000_000


def points(spark, times, dur=1000):
    return spark.createDataFrame([(1, i, int(t * S), int(dur * S)) for i, t in enumerate(times)], "media_id bigint, sample_id bigint, ts_us bigint, duration_us bigint")


def test_phase_sampling_and_grid(spark):
    t = points(spark, [2, 3, 5, 7, 9])
    got = lambda phase: [r["sample_id"] for r in sm.sample_phase(t, gap=3 * S, phase=int(phase * S)).orderBy("ts_us").collect()]
    assert got(0) == [0, 1, 3, 4] and got(2.5) == [1, 3, 4]
    assert sm.phase_grid(3 * S, S) == [0, 750_000, S, 1_500_000, 2 * S, 2_250_000]


def test_greedy_folds(spark):
    random.seed(5)
    times = sorted(random.sample(range(300), 80))
    kept, last = [], None
    for x in times:
        if last is None or x - last >= 7:
            kept.append(x)
            last = x
    assert sorted(r["ts_us"] // S for r in sm.sample_min_gap(points(spark, times), gap=7 * S).collect()) == kept


@pytest.mark.parametrize("seed,spread,gap,chunk", [(1, 400, 7, 20), (2, 400, 7, 7), (3, 3000, 40, 45), (4, 60, 9, 1000), (5, 5000, 3, 11)])
def test_min_gap_in_chunks_equals_one_pass(spark, seed, spread, gap, chunk):
    rng = np.random.default_rng(seed)
    rows, kept = [], []
    for m in (1, 2, None, 7):
        times, last = sorted(rng.integers(-spread, spread, int(rng.integers(1, 150))).tolist()), None
        rows += [(m, t) for t in times]
        for t in times:
            if last is None or t - last >= gap:
                kept.append((m, t))
                last = t
    frame = spark.createDataFrame([*rows, (1, None)], "media_id bigint, ts_us bigint")
    want = sorted(r for r in kept if r[0] is not None)
    got = lambda **o: sorted((r["media_id"], r["ts_us"]) for r in sm.sample_min_gap(frame.where("media_id is not null"), gap=gap, **o).collect())
    assert got() == want and got(chunk=chunk) == want
    assert sorted(r["ts_us"] for r in sm.sample_min_gap(frame, gap=gap).where("media_id is null").collect()) == [t for m, t in kept if m is None]
    assert sm.sample_min_gap(frame.limit(0), gap=gap, chunk=chunk).count() == 0


def test_min_gap_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        test_min_gap_in_chunks_equals_one_pass(spark, 6, 300, 5, 30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("batch", [3, 10_000])
def test_dedupe_close_is_the_plain_walk(spark, batch):
    rng = random.Random(batch)
    rows = [(m, i, rng.randrange(0, 120), rng.random() < 0.3) for m in (1, 2, 3) for i in range(60)]
    want = []
    for m in (1, 2, 3):
        kept = None
        for row in sorted((t, not scene, i) for k, i, t, scene in rows if k == m):
            row = (row[0], not row[1], row[2])
            if kept is not None and row[0] - kept[0] <= 4:
                if row[1] and not kept[1]:
                    kept = row
                continue
            want += [(m, *kept)] if kept else []
            kept = row
        want.append((m, *kept))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        frame = spark.createDataFrame([*rows, (2, 99, None, True)], "media_id bigint, sample_id bigint, ts_us bigint, scene boolean")
        got = sm.dedupe_close(frame, tol=4).collect()
        assert sorted((r["media_id"], r["ts_us"], r["scene"], r["sample_id"]) for r in got) == sorted(want)
        assert sm.dedupe_close(frame.limit(0), tol=4).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_long_timeline_is_many_tasks(spark):
    n = 400_000
    frame = spark.range(n).selectExpr("1L as media_id", "id * 1000 + (id * 7919) % 997 as ts_us")
    out = sm.sample_min_gap(frame, gap=10_500, chunk=1_000_000)
    spread = out.groupBy(F.spark_partition_id()).count().collect()
    times = np.sort(np.arange(n) * 1000 + np.arange(n) * 7919 % 997)
    kept, at = 0, 0
    while at < n:
        kept, at = kept + 1, int(np.searchsorted(times, times[at] + 10_500))
    assert sum(r["count"] for r in spread) == kept and len(spread) > 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("chunk" in x for x in plan.splitlines() if "hashpartitioning(media_id" in x)


def test_candidate_windows(spark):
    scores = spark.createDataFrame([(1, 10 * S, 0.2, False), (1, 14 * S, 0.8, False), (1, 50 * S, 0.1, False)], "media_id bigint, ts_us bigint, a double, included boolean")
    text = spark.createDataFrame([(1, 15 * S, 18 * S, 0.0, [16 * S])], "media_id bigint, start_us bigint, end_us bigint, peak double, evidence_us array<bigint>")
    media = spark.createDataFrame([(1, 60 * S)], "media_id bigint, duration_us bigint")
    out = pl.group_candidate_windows(scores, text, media, threshold=0.15, gap=5 * S, pad=2 * S, longest=60 * S).collect()
    assert [(r["start_us"], r["end_us"], r["peak"], r["evidence_us"], r["trigger"]) for r in out] == [(8 * S, 20 * S, 0.8, [10 * S, 14 * S, 16 * S], "visual_and_text")]


def split_model(times, longest, context):
    if times[-1] - times[0] + 2 * context <= longest or len(times) == 1:
        return [times]
    gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
    k = gaps.index(max(gaps)) + 1
    return split_model(times[:k], longest, context) + split_model(times[k:], longest, context)


def test_cluster_split_equals_the_recursion(spark):
    random.seed(8)
    for case in range(4):
        times = sorted(random.sample(range(0, 400), 90)) if case else list(range(0, 200, 2))
        groups, now = [], [times[0]]
        for x in times[1:]:
            if x - now[-1] > 8:
                groups.append(now)
                now = []
            now.append(x)
        groups.append(now)
        want = sorted((g[0], g[-1], len(g)) for grp in groups for g in split_model(grp, 30, 2))
        rows = points(spark, times).withColumns({"by_a": F.lit(True), "by_b": F.lit(False)})
        out = pl.cluster_events(rows, gap=8 * S, context=2 * S, longest=30 * S)
        assert sorted((r["first_us"] // S, r["last_us"] // S, r["n_samples"]) for r in out.collect()) == want


def brute_matching(w):
    n, m = w.shape
    best = (0, 0.0)
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                vals = [w[r, c] for r, c in zip(rows, cols, strict=True)]
                if all(v > 0 for v in vals):
                    best = max(best, (k, sum(vals)))
    return best


def test_matching_is_best(spark):
    rng = np.random.default_rng(4)
    for _ in range(150):
        w = rng.random((int(rng.integers(1, 5)), int(rng.integers(1, 5))))
        w[rng.random(w.shape) < 0.4] = 0
        got = mt.assign(w)
        assert len({r for r, _ in got}) == len(got) == len({c for _, c in got})
        k, total = brute_matching(w)
        assert len(got) == k and sum(w[r, c] for r, c in got) == pytest.approx(total)


def test_statistics(spark):
    low, high = fn.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(F.round(low, 4).alias("l"), F.round(high, 4).alias("h"), fn.wilson(F.lit(0), F.lit(0))[0].alias("n")).first()
    assert (r["l"], r["h"], r["n"]) == (0.4902, 0.9433, None)
    p = spark.createDataFrame([(0, 5), (3, 3), (0, 0)], "b bigint, c bigint").select(F.round(st.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))
    assert [r["p"] for r in p.collect()] == [0.0625, 1.0, None]
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None)], "name string, p double")
    assert {r["name"]: r["adjusted"] for r in st.holm(tests).collect()} == {"a": 0.02, "b": 0.04, "c": None}


def test_static_reduction(spark):
    rows = [(1, i, t * S, 0, False, 0.0, 100.0, h) for i, (t, h) in enumerate([(0, 7), (1, 7), (2, 7), (11, 7), (12, 1 << 40)])] + [(1, 5, 13 * S, 0, False, 1.0, 0.0, 0), (1, 6, 14 * S, 0, False, 0.0, 100.0, 1 << 40)]
    t = spark.createDataFrame(rows, "media_id bigint, sample_id bigint, ts_us bigint, chunk bigint, scene boolean, black_fraction double, mean_luma double, hash bigint")
    got = {r["sample_id"]: (r["disposition"], r["duplicate_of_us"]) for r in sm.reduce_static(t).collect()}
    rep = ("representative", None)
    assert got == {0: rep, 1: ("static_suppressed", 0), 2: ("static_suppressed", 0), 3: rep, 4: rep, 5: ("black", None), 6: rep}


def test_scorer_failures_are_included(spark):
    def fails(b):
        raise RuntimeError("no model")

    out = pl.score(points(spark, [1, 2]), fails).collect()
    assert all(r["probability"] == 1.0 and r["included"] for r in out)


def stream(spark, tmp_path, frame, make, name):
    path = str(tmp_path / name)
    frame.repartition(1).sortWithinPartitions("ts_us").write.json(path)
    rows = sx.stream_samples(spark, path, "media_id BIGINT, sample_id BIGINT, ts_us BIGINT", delay="0 seconds")
    q = make(rows).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}-check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_online_equals_batch(spark, tmp_path):
    random.seed(6)
    t = points(spark, sorted(random.sample(range(1, 500), 120))).select("media_id", "sample_id", "ts_us")
    online = stream(spark, tmp_path, t, lambda r: sx.route_phase(r, gap=7 * S, phase=2 * S), "phase")
    assert sorted(r["sample_id"] for r in online.collect()) == sorted(r["sample_id"] for r in sm.sample_phase(t, gap=7 * S, phase=2 * S).collect())
    online = stream(spark, tmp_path, t, lambda r: sx.route_min_gap(r, gap=9 * S), "mingap")
    assert sorted(r["ts_us"] for r in online.collect()) == sorted(r["ts_us"] for r in sm.sample_min_gap(t, gap=9 * S).collect())
    online = stream(spark, tmp_path, t.union(t), sx.dedupe_replays, "replays")
    assert online.count() == 120


def test_sources_round_trip(spark, tmp_path):
    score = {"schema_version": 1, "media_id": "m", "duration_us": 9, "samples": [{"sample_id": "s", "timestamp_us": 5, "nsfl": 0.1, "nsfw": 0.2, "sfw": 0.7, "selected_label": "sfw", "reasons": ["x"]}]}
    (tmp_path / "s.json").write_text(json.dumps(score))
    assert [tuple(r)[:6] for r in rd.read_scores(spark, str(tmp_path / "s.json")).collect()] == [("m", 9, "s", 5, 0.1, 0.2)]
    (tmp_path / "g.json").write_text(json.dumps({"media_id": "m", "duration": "00:01:00", "cuts": [{"start": "00:00:01.5", "end": "00:00:03", "category": "c"}, {"start": "00:00:09", "end": "00:00:03"}, {"start": "x", "end": "00:00:03"}]}))
    got = [(r["start_us"], r["end_us"], r["problem"]) for r in rd.read_ground_truth(spark, str(tmp_path / "g.json")).orderBy("interval_index").collect()]
    assert got == [(1_500_000, 3 * S, None), (9 * S, 3 * S, "reversed"), (None, 3 * S, "not a timecode")]
    cuts = spark.createDataFrame([("v.mp4", 1_500_000, 2 * S), ("v.mp4", 0, S)], "filename string, start_us bigint, end_us bigint")
    media = spark.createDataFrame([("v.mp4", 60 * S)], "filename string, duration_us bigint")
    sinks.write_cuts(cuts, media, str(tmp_path / "cuts"))
    assert [tuple(r) for r in rd.read_cuts(spark, str(tmp_path / "cuts")).collect()] == [("v.mp4", 0, S), ("v.mp4", 1_500_000, 2 * S)]
    (tmp_path / "p.csv").write_text("1.000,K__,aa\n1.080,___,bb\n1.040,___,cc\n")
    assert [(r["decode_pos"], r["pts_us"], r["is_key"], r["data_hash"]) for r in rd.read_packets(spark, str(tmp_path / "p.csv"), "m").orderBy("decode_pos").collect()] == [(0, 0, True, "aa"), (1, 80_000, False, "bb"), (2, 40_000, False, "cc")]
    (tmp_path / "c.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\n<i>Hi</i>\\Nyou &amp; me\n\n2\n00:00:05,000 --> 00:00:04,000\nback\n\n3\n00:00:06,000 --> 00:00:07,000\n{\\an8}\n")
    assert [(r["start_us"], r["end_us"], r["text"]) for r in rd.read_cues(spark, str(tmp_path / "c.srt")).collect()] == [(S, 2_500_000, "Hi\nyou & me")]
    (tmp_path / "j.jsonl").write_text('{"item_id":"a","kind":"x","attempt_no":1}\n{"item_id":"b","kind":"y"}\n')
    assert [r["item_id"] for r in rd.read_journal(spark, str(tmp_path / "j.jsonl"), "y").collect()] == ["b"]
    (tmp_path / "files").mkdir()
    for n in ("Film.mp4", "film.en.srt", "film.srt", "other.srt"):
        (tmp_path / "files" / n).write_text("x")
    found, subs = rd.discover_files(spark, str(tmp_path / "files")), rd.discover_files(spark, str(tmp_path / "files"), rd.SIDECARS)
    assert sorted(r["sidecar"].rsplit("/", 1)[1] for r in rd.match_sidecars(found, subs).collect()) == ["film.en.srt", "film.srt"]
    assert {r["sha256"] for r in rd.fingerprint_files(spark, str(tmp_path / "files")).collect()} == {"2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"}
    (tmp_path / "a.json").write_text('{"v": {"age": [{"first": 0, "last": 9, "values": [1, 2]}, {"first": 12, "last": 20, "values": []}]}}')
    assert rd.read_frame_annotations(spark, str(tmp_path / "a.json")).count() == 2
    sinks.write_policy_table(cuts.withColumn("x", F.array(F.lit(1))), str(tmp_path / "table"))
    sinks.write_once(cuts, str(tmp_path / "once"))
    with pytest.raises(Exception, match="exist"):
        sinks.write_once(cuts, str(tmp_path / "once"))
    (tmp_path / "b.json").write_text('{"prompts": [{"concept_id": "c", "prompt": [1.0, 2.0]}]}')
    assert len(rd.read_prompt_bank(spark, str(tmp_path / "b.json")).first()["bank_digest"]) == 64
    (tmp_path / "k.json").write_text('{"media_id": "m", "bank_digest": "d", "samples": [{"sample_id": "s", "timestamp_us": 1, "scores": [{"concept_id": "c", "cosine": 0.5, "logit": 50}]}]}')
    assert [tuple(r) for r in rd.read_semantic_scores(spark, str(tmp_path / "k.json")).collect()] == [("m", "d", "s", 1, "c", 0.5, 50.0)]
    for n in ("train", "test"):
        (tmp_path / f"{n}.csv").write_text("id,subject\n1,s\n")
    both = rd.read_catalogue(spark, {n: str(tmp_path / f"{n}.csv") for n in ("train", "test")}, "id INT, subject STRING")
    assert sorted(r["split"] for r in both.collect()) == ["test", "train"]


def test_nearest_rows_are_taken_in_order(spark):
    from spanframe.operators.alignment import align_by_id, align_nearest

    side = lambda rows: spark.createDataFrame(rows, "media_id bigint, sample_id bigint, ts_us bigint")
    a = side([(1, 1, 0), (1, 2, 1000), (2, 3, 50), (2, 4, 60), (3, 5, 9)])
    b = side([(1, 11, 900), (1, 12, 2500), (2, 13, 55), (2, 14, 10_000), (4, 15, 9)])
    got = {r["sample_id"]: (r["r_sample_id"], r["distance_us"]) for r in align_nearest(a, b, tol=2000).collect()}
    assert got == {1: (11, 900), 2: (12, 1500), 3: (13, 5), 4: (None, None), 5: (None, None)}
    _, audit = align_by_id(a, side([(1, 1, 0), (1, 2, 7), (1, 2, 1000), (9, 9, 9)]))
    assert audit.first().asDict() == {"n_left": 5, "n_right": 4, "left_only": 3, "right_only": 1, "repeated": 1, "moved": 1, "exact": False}


def test_nearest_rows_against_brute_force(spark):
    import random

    from spanframe.operators.alignment import align_nearest

    random.seed(5)
    rows = lambda base: [(m, base + i, random.randrange(3000)) for m in range(3) for i in range(m * 100, m * 100 + 60)]
    a, b, want = rows(0), rows(1000), {}
    for m in range(3):
        left = sorted((t, i) for k, i, t in a if k == m)
        rest = sorted((t, i) for k, i, t in b if k == m)
        for t, i in left:
            best = min(rest, key=lambda r: (abs(r[0] - t), r), default=None)
            if best is not None and abs(best[0] - t) <= 40:
                rest.remove(best)
                want[i] = best[1]
            else:
                want[i] = None
    schema = "media_id bigint, sample_id bigint, ts_us bigint"
    got = align_nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), tol=40)
    assert {r["sample_id"]: r["r_sample_id"] for r in got.collect()} == want and None in want.values()


def test_a_logo_in_one_region_tells_frames_apart(spark):
    from spanframe.operators.sampling import frame_features, reduce_static

    width, height = 18, 16
    plain = [float((x * 7) % 50 + 60) for _ in range(height) for x in range(width)]
    logo = [180.0 - v if y < 8 and x < 9 else v for i, v in enumerate(plain) for x, y in [(i % width, i // width)]]
    rows = [(1, i, i * 1000, 0, False, grid) for i, grid in enumerate([plain, plain, logo, logo, [0.0] * len(plain), logo])]
    frames = spark.createDataFrame(rows, "media_id bigint, sample_id bigint, ts_us bigint, chunk bigint, scene boolean, luma array<double>")
    features = frame_features(frames, "luma", width, height, rgb=("luma", "luma", "luma"))
    first = features.where("sample_id = 2").first()
    assert len(first["region_hashes"]) == 5 and len(first["region_rgb"]) == 15 and len(first["mean_rgb"]) == 3
    got = {r["sample_id"]: (r["disposition"], r["duplicate_of_us"]) for r in reduce_static(features, colour=255.0).collect()}
    assert got == {0: ("representative", None), 1: ("static_suppressed", 0), 2: ("representative", None), 3: ("static_suppressed", 2000), 4: ("black", None), 5: ("representative", None)}


def test_events_split_like_the_recursion(spark):
    import random

    from spanframe.operators.planning import cluster_events

    random.seed(8)
    times = sorted(random.sample(range(2000), 120))

    def split(ts, longest):
        if ts[-1] - ts[0] + 2 * 5 <= longest or len(ts) == 1:
            return [ts]
        at = max(range(1, len(ts)), key=lambda i: (ts[i] - ts[i - 1], -i))
        return split(ts[:at], longest) + split(ts[at:], longest)

    groups = [[times[0]]]
    for t in times[1:]:
        groups.append([t]) if t - groups[-1][-1] > 30 else groups[-1].append(t)
    rows = spark.createDataFrame([(1, i, t, True, False, 5000) for i, t in enumerate(times)], "media_id bigint, sample_id bigint, ts_us bigint, by_a boolean, by_b boolean, duration_us bigint")
    for longest in (12, 60, 200):
        got = sorted((r["first_us"], r["last_us"], r["n_samples"]) for r in cluster_events(rows, gap=30, context=5, longest=longest).collect())
        assert got == sorted((g[0], g[-1], len(g)) for x in groups for g in split(x, longest))


def test_invariants_see_rows_that_arrived_out_of_order(spark):
    from spanframe.operators.sampling import check_invariants

    rows = spark.createDataFrame([(1, 1, 5, 100, "black"), (1, 2, 4, 100, "black"), (1, 3, 9, 100, "black")], "media_id bigint, n bigint, ts_us bigint, duration_us bigint, disposition string")
    got = {r["name"]: r["passed"] for r in check_invariants(rows, core=50, gap=95, arrival="n").collect()}
    assert not got["sorted"] and got["in_range"] and got["longest_gap"]


def test_json_objects_nest_and_must_parse(spark):
    from pyspark.sql import functions as F

    from spanframe.functions.columns import content_key, first_json_object

    texts = ['text {a} {"k":1}', 'x {"a": {"b": [1, {"c": 2}]}} y', "{ {", "none", None, '{"k": 2}', "} {\"z\": 3}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(first_json_object(F.col("t"))).collect()]
    assert got == ['{"k":1}', '{"a": {"b": [1, {"c": 2}]}}', None, None, None, '{"k": 2}', '{"z": 3}']
    keys = spark.createDataFrame([("", "x"), (None, "x"), ("a|b=2", None), ("a", "2")], "a string, b string").select(content_key({"a": F.col("a"), "b": F.col("b")})).collect()
    assert len({r[0] for r in keys}) == 4


def test_events_behind_exclusions(spark):
    """Event evaluation against plain interval arithmetic, with ranges cut out, hidden events and contested pairs."""
    rng = np.random.default_rng(9)
    length, cats = 120, ("a", "b")
    cells = lambda s, e: set(range(s, e))
    sides, hidden = {"p": [], "t": []}, []
    for m in range(12):
        for side in sides:
            for i in range(int(rng.integers(0, 9))):
                s = int(rng.integers(0, length - 12))
                sides[side].append((m, i, s, s + int(rng.integers(1, 12)), cats[int(rng.integers(2))]))
        hidden += [(m, s, s + int(rng.integers(1, 15))) for s in rng.integers(0, length - 15, 3).tolist()]
    schema = "media_id bigint, interval_id bigint, start_us bigint, end_us bigint, category string"
    frames = [spark.createDataFrame([*sides[x], (0, 99, 5, 9, None), (77, 1, 0, 5, "a")], schema) for x in ("p", "t")]
    media = spark.createDataFrame([(m, length) for m in range(12)], "media_id bigint, duration_us bigint")
    cut = spark.createDataFrame(hidden, "media_id bigint, start_us bigint, end_us bigint")
    got = {(r["media_id"], r["category"], r["threshold"]): r for r in mt.evaluate_media(*frames, media, cut, thresholds=(0.1, 0.4), width=7).collect()}
    want = 0
    for m, cat, least in itertools.product(range(12), cats, (0.1, 0.4)):
        gone = set().union(*(cells(s, e) for k, s, e in hidden if k == m))
        seen = {x: [(s, e, cells(s, e) - gone) for k, _, s, e, c in sides[x] if k == m and c == cat] for x in sides}
        if not seen["p"] and not seen["t"]:
            continue
        want += 1
        r = got[m, cat, least]
        shown = {x: [v for v in seen[x] if v[2]] for x in seen}
        w = np.array([[len(p[2] & t[2]) / len(p[2] | t[2]) for t in shown["t"]] for p in shown["p"]]).reshape(len(shown["p"]), len(shown["t"]))
        tp = len(mt.assign(np.where(w >= least, w, 0)))
        p, t = (set().union(*(v[2] for v in shown[x])) for x in "pt")
        expect = (tp, len(shown["p"]) - tp, len(shown["t"]) - tp, len(seen["p"]) - len(shown["p"]), len(seen["t"]) - len(shown["t"]), len(p), len(t), len(p & t), length - len(gone))
        assert tuple(r[c] for c in ("tp", "fp", "fn", "ignored_predicted", "ignored_true", "predicted_us", "target_us", "covered_us", "evaluated_us")) == expect
    assert len(got) == want
    whole = mt.evaluate_media(*frames, media, binary=True, thresholds=(0.4,), width=7).collect()
    assert {r["category"] for r in whole} == {"binary"} and all(r["ignored_true"] == 0 for r in whole)
    none = mt.evaluate_media(frames[0].limit(0), frames[1].limit(0), media, cut, width=7)
    assert none.count() == 0 and mt.aggregate_events(none).count() == 0


def test_scorable_items(spark):
    items = spark.createDataFrame([(1, True, ["a"]), (2, True, []), (3, None, ["a"]), (4, True, ["a"])], "media_id bigint, binary_exhaustive boolean, exhaustive_categories array<string>")
    runs = spark.createDataFrame([(1, "completed"), (2, "failed"), (4, None)], "media_id bigint, status string")
    got = lambda c: {r["media_id"]: r["usable"] for r in mt.scorable(items, runs, c).collect()}
    assert got(None) == {1: True, 2: False, 4: False} and got("a") == {1: True, 4: False}


def test_clustering_grid_equals_one_setting_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [(m, i, int(t) * S, bool(rng.integers(2)), bool(rng.integers(2)), 200 * S) for m in range(4) for i, t in enumerate(np.sort(rng.integers(0, 180, 25)))]
    df = spark.createDataFrame(rows, "media_id bigint, sample_id bigint, ts_us bigint, by_a boolean, by_b boolean, duration_us bigint").where("by_a or by_b")
    grid = [(g * S, c * S, m * S) for g in (1, 5, 20) for c in (0, 2) for m in (10, 30)]
    table = {(r["gap"], r["context"], r["longest"], r["media_id"]): r for r in pl.evaluate_clustering(df, grid).collect()}
    for g, c, m in grid:
        one = pl.cluster_events(df, gap=g, context=c, longest=m).toPandas()
        for k, x in one.groupby("media_id"):
            r, size = table[g, c, m, k], x["end_us"] - x["start_us"]
            assert (r["n_events"], r["total_us"], r["longest_us"], r["n_candidates"]) == (len(x), size.sum(), size.max(), x["n_samples"].sum())
            assert [r[p] for p in ("a_only", "b_only", "both")] == [(x["profile"] == p).sum() for p in ("a_only", "b_only", "both")]
            assert r["median_us"] == size.median() and r["p90_us"] == pytest.approx(size.quantile(0.9))
    assert pl.evaluate_clustering(df.limit(0), grid).count() == 0
