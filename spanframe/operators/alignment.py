"""Joins that align samples, references, labels and transcripts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .timeline import KEY, ordered_pass, range_join


def align_by_id(a: DataFrame, b: DataFrame, *, ts: str = "ts_us", ident: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Rows of a with b's other columns by id, with same_time; and the audit of the cover: one row with n_left, n_right,
    left_only, right_only, repeated (rows beyond the first of an id, on either side), moved (other times) and exact."""
    right = b.withColumnRenamed(ts, "__t2")
    pairs = a.join(right, [KEY, ident]).withColumn("same_time", F.col(ts) == F.col("__t2")).drop("__t2")
    count = lambda df, side: df.groupBy(KEY, ident).agg(F.count("*").alias(side), F.min(ts).alias(f"{side}_t"))
    ids = count(a, "l").join(count(b, "r"), [KEY, ident], "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    audit = ids.agg(n("l").alias("n_left"), n("r").alias("n_right"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), (n(F.greatest(F.col("l") - 1, F.lit(0))) + n(F.greatest(F.col("r") - 1, F.lit(0)))).alias("repeated"), F.count_if(F.col("l_t") != F.col("r_t")).alias("moved"))
    return pairs, audit.withColumn("exact", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("repeated") == 0))


def align_nearest(a: DataFrame, b: DataFrame, *, tol: int, ts: str = "ts_us", ident: str = "sample_id") -> DataFrame:
    """Rows of a, in the order of time, each with the nearest row of b that none before has taken (of equals the earliest, then
    the smallest id): r_<ident> and distance_us, which are null where none is left within tol.

    One ordered pass holds what lies within tol of the row at hand."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        waiting: deque[tuple] = deque()
        right: list[tuple] = []

        def take(t: int, name: object) -> tuple:
            right[:] = [r for r in right if r[0] >= t - tol]
            best = min((r for r in right if r[0] <= t + tol), key=lambda r: (abs(r[0] - t), r), default=None)
            if best is None:
                return name, None, None
            right.remove(best)
            return name, best[1], abs(best[0] - t)

        for t, side, name in rows:
            while waiting and waiting[0][0] + tol < t:
                yield take(*waiting.popleft())
            if side == 0:
                waiting.append((t, name))
            else:
                if not waiting:  # what no later row can reach
                    right[:] = [r for r in right if r[0] >= t - tol]
                right.append((t, name))
        while waiting:
            yield take(*waiting.popleft())

    both = a.select(KEY, F.col(ts).alias("t"), F.lit(0).alias("side"), F.col(ident).alias("name")).union(b.select(KEY, F.col(ts), F.lit(1), F.col(ident)))
    kind = a.schema[ident].dataType.simpleString()
    return ordered_pass(both, [KEY], ["t", "side", "name"], ["t", "side", "name"], fold, f"{ident} {kind}, r_{ident} {kind}, distance_us bigint")


def frames_to_time(segments: DataFrame, frames: DataFrame, *, frame_us: int) -> DataFrame:
    """Inclusive frame ranges to times: the pts of the first frame, and that of the last plus one frame; null if unknown."""
    at = lambda n: frames.select(KEY, F.col("frame").alias(n), F.col("pts_us").alias(f"__{n}"))
    out = segments.join(at("first_frame"), [KEY, "first_frame"], "left").join(at("last_frame"), [KEY, "last_frame"], "left")
    return out.withColumns({"start_us": F.col("__first_frame"), "end_us": F.col("__last_frame") + frame_us}).drop("__first_frame", "__last_frame")


def local_refs_to_time(responses: DataFrame, *, refs: str = "refs", frames: str = "frames", margin: int = 500_000) -> DataFrame:
    """1-based frame numbers of a batch to a time range widened by margin and clamped to the batch; all of it without any."""
    times = F.array_compact(F.transform(refs, lambda i: F.try_element_at(F.col(frames), F.when(i > 0, i))))
    rows = responses.withColumn("__t", times)
    lo, hi = F.array_min("__t"), F.array_max("__t")
    start = F.coalesce(F.greatest(F.col("start_us"), lo - margin), F.col("start_us"))
    end = F.coalesce(F.least(F.col("end_us"), hi + margin), F.col("end_us"))
    return rows.withColumns({"from_us": F.when(lo.isNull(), F.col("start_us")).otherwise(start), "to_us": F.when(hi.isNull(), F.col("end_us")).otherwise(end)}).drop("__t")


def sidecar_policy(media: DataFrame, embedded: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """keep_embedded if a media has embedded tracks, else add_external with the first external path, else none."""
    e = embedded.groupBy(key).agg(F.count("*").alias("n_embedded"))
    x = external.groupBy(key).agg(F.min("path").alias("first_external"))
    out = media.join(e, key, "left").join(x, key, "left")
    policy = F.when(F.col("n_embedded") > 0, "keep_embedded").when(F.col("first_external").isNotNull(), "add_external").otherwise("none")
    return out.withColumn("policy", policy).drop("n_embedded")


def frame_targets(events: DataFrame, frames: DataFrame, *, ids: str = "frame_ids") -> tuple[DataFrame, DataFrame]:
    """One row for each selected frame of an event with its position, resolved; and those that no frame resolves."""
    rows = events.select("*", F.posexplode(ids).alias("position", "sample_id")).drop(ids)
    return rows.join(frames, "sample_id", "left"), rows.join(frames, "sample_id", "left_anti")


def transcript_source(subtitles: DataFrame, speech: DataFrame, media: DataFrame) -> DataFrame:
    """Per media its subtitle segments if any is usable, else its speech segments, else one row with a warning."""
    usable = subtitles.where("end_us > start_us and trim(text) <> ''").withColumn("source", F.lit("subtitle"))
    heard = speech.join(usable.select(KEY).distinct(), KEY, "left_anti").withColumn("source", F.lit("speech"))
    both = usable.unionByName(heard, allowMissingColumns=True).withColumn("warning", F.lit(None).cast("string"))
    none = media.select(KEY).join(both.select(KEY).distinct(), KEY, "left_anti").withColumn("warning", F.lit("no transcript"))
    return both.unionByName(none, allowMissingColumns=True)


def lookup(df: DataFrame, dimension: DataFrame, on: str, value: str, default: str) -> DataFrame:
    """A dimension's value, or the default; the dimension is joined as Spark sees fit by its size."""
    return df.join(dimension, on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def interval_verdicts(events: DataFrame, intervals: DataFrame, *, tol: int, width: int) -> DataFrame:
    """Per interval: ids of overlapping events, and whether any was unsafe, of its category, exactly or within tol."""
    pairs = range_join(intervals, events, width=width, tol=tol, unmatched=(KEY, "interval_id"))
    exact = (F.col("start_us") <= F.col("r_end_us")) & (F.col("r_start_us") <= F.col("end_us"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = pairs.groupBy(KEY, "interval_id", "category").agg(F.array_sort(F.collect_set("r_interval_id")).alias("events"), any_of(F.col("r_unsafe") & exact).alias("detected"), any_of(F.col("r_unsafe")).alias("detected_near"), any_of(F.col("r_unsafe") & exact & (F.col("category") == F.col("r_category"))).alias("category_detected"))
    return out


def summarize_verdicts(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("int")).alias(f"{c}_rate")
    return verdicts.groupBy(*by).agg(F.count("*").alias("n"), rate("detected"), rate("detected_near"), rate("category_detected"))


def alert_review(alerts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Alerts by label, and precision only where every alert is reviewed."""
    out = alerts.groupBy(*by).agg(F.count("*").alias("n_alerts"), F.count_if(F.col("label") == "positive").alias("n_true"), F.count_if(F.col("label").isNull()).alias("n_open"))
    return out.withColumn("precision", F.when(F.col("n_open") == 0, ratio(F.col("n_true"), F.col("n_alerts"))))


def category_sets(rows: DataFrame, said: str, true: str) -> DataFrame:
    """Missing and extra categories of a row, and whether the sets are equal."""
    return rows.withColumns({"missing": F.array_except(true, said), "extra": F.array_except(said, true), "exact": F.array_sort(F.array_distinct(said)) == F.array_sort(F.array_distinct(true))})


def response_rules(df: DataFrame, *, refs: str = "refs", frames: str = "frames") -> dict[str, Column]:
    """Rules of model responses: references positive, unique and inside the batch, interval inside its bounds."""
    inside = F.forall(refs, lambda i: (i >= 1) & (i <= F.size(frames)))
    return {"references": inside, "unique": F.size(refs) == F.size(F.array_distinct(refs)), "interval": F.col("from_us").between(F.col("start_us"), F.col("end_us")) & (F.col("to_us") >= F.col("from_us"))}


def repro_compare(first: DataFrame, second: DataFrame, ident: Sequence[str], scores: str, *, tol: float) -> DataFrame:
    """Greatest absolute score difference of two runs' score arrays, and whether it is within tol."""
    b = second.select(*ident, F.col(scores).alias("__b"))
    off = F.array_max(F.zip_with(scores, "__b", lambda x, y: F.abs(x - y)))
    return first.join(b, list(ident)).select(*ident, off.alias("max_difference"), (F.coalesce(off <= tol, F.lit(False))).alias("within"))
