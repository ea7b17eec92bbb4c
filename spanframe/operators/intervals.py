"""Interval algebra on (media_id, start_us, end_us) tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import KEY, as_of, interval_islands, range_join

_CARRY = {"max": F.max, "min": F.min, "or": F.bool_or, "sum": F.sum}


def _carried(carry: Mapping[str, str]) -> list[Column]:
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return [(union(c) if kind == "union" else _CARRY[kind](c)).alias(c) for c, kind in carry.items()]


def pad_and_clamp(df: DataFrame, *, pad: int = 0, duration: str | None = None, on_empty: str = "drop") -> DataFrame:
    """Widens by pad, clamps to [0, duration]; what is then empty is dropped, kept, or an error."""
    lo, hi = F.col("start_us") - pad, F.col("end_us") + pad
    if duration is not None:
        lo, hi = F.greatest(F.lit(0), F.least(lo, F.col(duration))), F.greatest(F.lit(0), F.least(hi, F.col(duration)))
    out = df.withColumns({"start_us": lo, "end_us": hi})
    if on_empty == "drop":
        return out.where("end_us > start_us")
    if on_empty == "error":
        checked = F.when(F.col("end_us") <= F.col("start_us"), F.raise_error(F.lit("an interval must end after its start")).cast("bigint")).otherwise(F.col("end_us"))
        return out.withColumn("end_us", checked)
    return out


def merge_intervals(df: DataFrame, *, pad: int = 0, gap: int = 0, eps: int = 0, duration: str | None = None, on_empty: str = "drop", carry: Mapping[str, str] | None = None, key: Sequence[str] = (KEY,), chunk: int | None = None) -> DataFrame:
    """Disjoint union: intervals merge when one starts at most gap + eps behind the end so far.

    carry: columns to aggregate along (max, min, or, sum, union of arrays). chunk: for long timelines, merges inside
    chunks of that many microseconds first, so that a timeline of any length is no single task until it is small.
    """
    carry = dict(carry or {})
    rows = pad_and_clamp(df, pad=pad, duration=duration, on_empty=on_empty)

    def level(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        grouped = interval_islands(rows, gap + eps, key=by).groupBy(*by, "island")
        return grouped.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), *_carried(carry)).drop("island")

    if chunk:
        rows = level(rows.withColumn("__chunk", F.floor(F.col("start_us") / chunk)), [*key, "__chunk"]).drop("__chunk")
    return level(rows, key)


def invert_intervals(df: DataFrame, media: DataFrame, *, key: Sequence[str] = (KEY,)) -> DataFrame:
    """What the intervals leave of [0, duration_us] of each media; a media without intervals is left whole."""
    merged = merge_intervals(df.join(media.select(*key, "duration_us"), list(key)), duration="duration_us", key=key)
    w = Window.partitionBy(*key).orderBy("start_us")
    gaps = merged.select(*key, F.coalesce(F.lag("end_us").over(w), F.lit(0)).alias("s"), F.col("start_us").alias("e"))
    tails = media.join(merged.groupBy(*key).agg(F.max("end_us").alias("last")), list(key), "left").select(*key, F.coalesce("last", F.lit(0)).alias("s"), F.col("duration_us").alias("e"))
    return gaps.unionByName(tails).where("e > s").select(*key, F.col("s").alias("start_us"), F.col("e").alias("end_us"))


def total_duration(df: DataFrame, *, overlap_aware: bool = False, key: Sequence[str] = (KEY,)) -> DataFrame:
    """Sum of lengths; overlap_aware counts what intervals share once."""
    rows = merge_intervals(df, key=key) if overlap_aware else df
    return rows.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("end_us") - F.col("start_us"))).alias("total_us"))


def intersect_intervals(a: DataFrame, b: DataFrame, *, width: int) -> DataFrame:
    """Overlaps of positive length of each pair; columns of b get the prefix r_."""
    pairs = range_join(a, b, width=width)
    both = {"overlap_start_us": F.greatest("start_us", "r_start_us"), "overlap_end_us": F.least("end_us", "r_end_us")}
    return pairs.withColumns(both).where("overlap_end_us > overlap_start_us")


def subtract_intervals(a: DataFrame, b: DataFrame, *, width: int, identity: str = "interval_id") -> DataFrame:
    """a without b; the fragments keep all columns of a. identity tells the rows of a apart within a media."""
    cut = intersect_intervals(a, merge_intervals(b), width=width)
    w = Window.partitionBy(KEY, identity).orderBy("overlap_start_us")
    cut = cut.withColumns({"begin": F.coalesce(F.lag("overlap_end_us").over(w), F.col("start_us")), "last": F.lead("overlap_end_us").over(w).isNull()})
    pieces = F.array(F.struct(F.col("begin").alias("s"), F.col("overlap_start_us").alias("e")), F.when(F.col("last"), F.struct(F.col("overlap_end_us").alias("s"), F.col("end_us").alias("e"))))
    parts = cut.withColumn("piece", F.explode(pieces)).where("piece.e > piece.s")
    parts = parts.withColumns({"start_us": F.col("piece.s"), "end_us": F.col("piece.e")}).select(a.columns)
    return parts.unionByName(a.join(cut.select(KEY, identity).distinct(), [KEY, identity], "left_anti").select(a.columns))


def iou(a: DataFrame, b: DataFrame, *, width: int) -> DataFrame:
    """Overlap over union of the two sides' durations for each media; 0 where undefined."""
    one, two = merge_intervals(a), merge_intervals(b)
    common = intersect_intervals(one, two, width=width).groupBy(KEY).agg(F.sum(F.col("overlap_end_us") - F.col("overlap_start_us")).alias("both_us"))
    out = total_duration(one).withColumnRenamed("total_us", "a_us").join(total_duration(two).withColumnRenamed("total_us", "b_us"), KEY, "full").join(common, KEY, "left")
    out = out.na.fill(0, ["a_us", "b_us", "both_us"])
    return out.withColumn("iou", F.coalesce(F.try_divide("both_us", F.col("a_us") + F.col("b_us") - F.col("both_us")), F.lit(0.0)))


def remap_after_deletion(points: DataFrame, deletes: DataFrame, *, ts: str = "ts_us") -> DataFrame:
    """remapped_us: each time minus what is deleted before it; inside a deletion, its start."""
    merged = merge_intervals(deletes)
    w = Window.partitionBy(KEY).orderBy("start_us").rowsBetween(Window.unboundedPreceding, -1)
    marks = merged.select(KEY, F.col("start_us").alias("mark_us"), F.col("end_us").alias("until"), F.coalesce(F.sum(F.col("end_us") - F.col("start_us")).over(w), F.lit(0)).alias("gone"))
    out = as_of(points, marks, ts=ts, payload=("until", "gone"))
    inside = F.least(F.col(ts), F.col("prev_until")) - F.col("prev_us")
    return out.withColumn("remapped_us", F.col(ts) - F.coalesce(F.col("prev_gone") + inside, F.lit(0))).drop("prev_us", "next_us", "prev_until", "prev_gone")


def rebuild_spans(spans: DataFrame, deletes: DataFrame, *, width: int, identity: str = "interval_id") -> DataFrame:
    """The spans that are left after deletions, on the timeline without them; empty ones are dropped."""
    left = subtract_intervals(spans, deletes, width=width, identity=identity)
    for c in ("start_us", "end_us"):
        left = remap_after_deletion(left, deletes, ts=c).withColumn(c, F.col("remapped_us")).drop("remapped_us")
    return left.where("end_us > start_us")


def nearest_marks(points: DataFrame, marks: DataFrame, *, ts: str = "ts_us", tol: int = 0) -> DataFrame:
    """on_mark: a mark lies within tol of the point; prev_us and next_us as in as_of."""
    out = as_of(points, marks, ts=ts)
    near = F.least(F.coalesce(F.col(ts) - F.col("prev_us"), F.lit(2**62)), F.coalesce(F.col("next_us") - F.col(ts), F.lit(2**62))) <= tol
    return out.withColumn("on_mark", near)


def safe_cut(requests: DataFrame, keys: DataFrame, media: DataFrame) -> DataFrame:
    """Requests widened to the key frame before the start and the one after the end (else 0 and the media's end)."""
    out = as_of(requests, keys, ts="start_us").withColumnRenamed("prev_us", "safe_start_us").drop("next_us")
    out = as_of(out, keys, ts="end_us").withColumnRenamed("next_us", "safe_end_us").drop("prev_us").join(media.select(KEY, "duration_us"), KEY)
    out = out.withColumn("no_key", F.col("safe_start_us").isNull() | F.col("safe_end_us").isNull())
    out = out.withColumns({"safe_start_us": F.coalesce("safe_start_us", F.lit(0)), "safe_end_us": F.coalesce("safe_end_us", "duration_us")})
    return out.withColumns({"extra_before_us": F.col("start_us") - F.col("safe_start_us"), "extra_after_us": F.col("safe_end_us") - F.col("end_us")})


def cut_plan(deletes: DataFrame, keys: DataFrame, media: DataFrame, *, width: int, eps: int = 2000, least: int = 1000) -> DataFrame:
    """Segments of an edit: delete the merged deletions; of what is kept, re-encode from a boundary that is no key frame to
    the neighbouring one, and copy the rest. Re-encoded ranges that touch within eps are one; shorter than least is dropped."""
    gone = merge_intervals(deletes.join(media.select(KEY, "duration_us"), KEY), duration="duration_us")
    kept = invert_intervals(deletes, media).withColumn("kept_id", F.col("start_us")).join(media.select(KEY, "duration_us"), KEY)
    heads = as_of(kept, keys, ts="start_us").where("start_us > 0 and not (prev_us <=> start_us)")
    heads = heads.select(KEY, "kept_id", "start_us", F.least(F.coalesce("next_us", "end_us"), F.col("end_us")).alias("stop"))
    tails = as_of(kept, keys, ts="end_us").where("end_us < duration_us and not (prev_us <=> end_us)")
    tails = tails.select(KEY, "kept_id", F.greatest(F.coalesce("prev_us", "start_us"), F.col("start_us")).alias("start_us"), F.col("end_us").alias("stop"))
    again = heads.unionByName(tails).withColumnRenamed("stop", "end_us")
    again = merge_intervals(again, eps=eps, key=(KEY, "kept_id")).where(F.col("end_us") - F.col("start_us") >= least)
    copies = subtract_intervals(kept.select(KEY, F.col("kept_id").alias("interval_id"), "start_us", "end_us"), again, width=width).where(F.col("end_us") - F.col("start_us") >= least)
    parts = [gone.select(KEY, F.lit("delete").alias("type"), "start_us", "end_us"), again.select(KEY, F.lit("reencode").alias("type"), "start_us", "end_us"), copies.select(KEY, F.lit("copy").alias("type"), "start_us", "end_us")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def clip_ranges(requests: DataFrame) -> DataFrame:
    """end_us clamped to duration_us; problem names requests that start at or behind the end of the media, or backwards."""
    clipped = F.least("end_us", "duration_us")
    problem = F.when(F.col("start_us") >= F.col("duration_us"), "starts after the media").when(clipped <= F.col("start_us"), "empty")
    return requests.withColumn("clipped_end_us", clipped).withColumn("problem", problem)


def clamp_points(df: DataFrame, points: str, duration: str) -> DataFrame:
    """An array of times clamped to [0, duration]."""
    return df.withColumn(points, F.transform(points, lambda x: F.greatest(F.lit(0).cast("bigint"), F.least(x, F.col(duration)))))


def duration_check(df: DataFrame, *, tol: int) -> DataFrame:
    """actual_us against expected_us: ok within tol, and a warning otherwise."""
    off = F.abs(F.col("actual_us") - F.col("expected_us"))
    return df.withColumn("ok", off <= tol).withColumn("warning", F.when(off > tol, F.format_string("duration differs by %d us", off)))


def played_coverage(played: DataFrame, media: DataFrame, *, eps: int = 1, complete: int = 500_000, least_gap: int = 250_000) -> DataFrame:
    """For each media: covered_us, unplayed_us, fully_played (at most complete unplayed), n_gaps longer than least_gap."""
    merged = merge_intervals(played.join(media.select(KEY, "duration_us"), KEY), duration="duration_us", eps=eps)
    gaps = invert_intervals(merged, media).where(F.col("end_us") - F.col("start_us") > least_gap).groupBy(KEY).agg(F.count("*").alias("n_gaps"))
    out = media.select(KEY, "duration_us").join(total_duration(merged), KEY, "left").join(gaps, KEY, "left").na.fill(0, ["total_us", "n_gaps"])
    out = out.withColumnRenamed("total_us", "covered_us").withColumn("unplayed_us", F.col("duration_us") - F.col("covered_us"))
    return out.withColumn("fully_played", F.col("unplayed_us") <= complete)
