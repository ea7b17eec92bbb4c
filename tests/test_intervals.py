from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanframe.operators import intervals as iv
from spanframe.operators.timeline import range_join

S = 1_000_000


def table(spark, rows, dur=None):
    frame = spark.createDataFrame([(1, i, int(a * S), int(b * S)) for i, (a, b) in enumerate(rows)], "media_id bigint, interval_id bigint, start_us bigint, end_us bigint")
    return frame if dur is None else frame.withColumn("duration_us", F.lit(int(dur * S)))


def media(spark, dur):
    return spark.createDataFrame([(1, int(dur * S))], "media_id bigint, duration_us bigint")


def spans(df):
    return sorted((r["start_us"] / S, r["end_us"] / S) for r in df.collect())


def test_invert(spark):
    assert spans(iv.invert_intervals(table(spark, [(33, 42)]), media(spark, 72))) == [(0, 33), (42, 72)]
    assert spans(iv.invert_intervals(table(spark, [(10, 20), (35, 40), (90, 100)]), media(spark, 120))) == [(0, 10), (20, 35), (40, 90), (100, 120)]
    assert spans(iv.invert_intervals(table(spark, []), media(spark, 5))) == [(0, 5)]


def test_merge_rules(spark):
    assert spans(iv.merge_intervals(table(spark, [(10, 20), (18, 30)]))) == [(10, 30)]
    assert spans(iv.merge_intervals(table(spark, [(10, 20), (20, 30), (30.1, 31)]))) == [(10, 30), (30.1, 31)]
    assert spans(iv.merge_intervals(table(spark, [(0.2, 1), (8.75, 9.8)], 10), pad=S // 2, duration="duration_us")) == [(0, 1.5), (8.25, 10)]
    assert spans(iv.merge_intervals(table(spark, [(1, 2), (3.2, 4), (8, 9)], 10), pad=S // 4, gap=3 * S // 4, duration="duration_us")) == [(0.75, 4.25), (7.75, 9.25)]
    with pytest.raises(Exception, match="after its start"):
        iv.merge_intervals(table(spark, [(42, 33)]), on_empty="error").collect()


def test_merge_in_chunks_equals_merge(spark):
    random.seed(1)
    rows = [(a, a + random.random() * 9) for a in (random.random() * 500 for _ in range(300))]
    t = table(spark, rows)
    assert spans(iv.merge_intervals(t, gap=S)) == spans(iv.merge_intervals(t, gap=S, chunk=20 * S))


def brute_points(rows, step=1):
    return {x for a, b in rows for x in range(int(a), int(b))}


def test_algebra_against_point_sets(spark):
    random.seed(2)
    for _ in range(3):
        a = [(x, x + random.randrange(1, 12)) for x in random.sample(range(100), 12)]
        b = [(x, x + random.randrange(1, 12)) for x in random.sample(range(100), 8)]
        pa, pb = brute_points(a), brute_points(b)
        ta, tb = table(spark, a), table(spark, b)
        left = iv.subtract_intervals(ta, tb, width=10 * S)
        assert brute_points(spans(left)) == pa - pb
        assert brute_points([(r["overlap_start_us"] / S, r["overlap_end_us"] / S) for r in iv.intersect_intervals(ta, tb, width=7 * S).collect()]) == pa & pb
        assert iv.iou(ta, tb, width=10 * S).first()["iou"] == pytest.approx(len(pa & pb) / len(pa | pb))
        points = spark.createDataFrame([(1, x * S) for x in range(0, 120, 3)], "media_id bigint, ts_us bigint")
        for r in iv.remap_after_deletion(points, tb).collect():
            assert r["remapped_us"] // S == r["ts_us"] // S - len([p for p in pb if p < r["ts_us"] // S])


def test_range_join_pairs_once(spark):
    random.seed(3)
    a = [(x, x + random.randrange(0, 40)) for x in (random.randrange(200) for _ in range(40))]
    b = [(x, x + random.randrange(0, 40)) for x in (random.randrange(200) for _ in range(40))]
    for width, tol in ((5, 0), (50, 3)):
        got = sorted((r["interval_id"], r["r_interval_id"]) for r in range_join(table(spark, a), table(spark, b), width=width * S, tol=tol * S).collect())
        assert got == sorted((i, j) for i, (s, e) in enumerate(a) for j, (u, v) in enumerate(b) if s - tol <= v and u <= e + tol)


def test_cut_plan_covers_the_media(spark):
    keys = spark.createDataFrame([(1, k * S) for k in range(0, 120, 5)], "media_id bigint, mark_us bigint")
    plan = iv.cut_plan(table(spark, [(33, 42), (50, 60)]), keys, media(spark, 100), width=20 * S)
    got = sorted((r["start_us"] / S, r["end_us"] / S, r["type"]) for r in plan.collect())
    assert got == [(0, 30, "copy"), (30, 33, "reencode"), (33, 42, "delete"), (42, 45, "reencode"), (45, 50, "copy"), (50, 60, "delete"), (60, 100, "copy")]
