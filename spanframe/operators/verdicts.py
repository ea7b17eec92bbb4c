"""Summaries of model verdicts over events and of the labelled intervals that these overlap.

answers(variant columns, media_id, event_id, category, answer) hold yes, no or null (unverified) of one question each, with
seconds and tokens; masks(.., categories) name all categories of an event at once, null if the answer had another form.
intervals(media_id, interval_id, category); pairs(media_id, interval_id, event_id) say which events overlap an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .timeline import KEY, range_join

LATENCY = ("mean_s", "p50_s", "p90_s")


def interval_pairs(events: DataFrame, intervals: DataFrame, *, width: int) -> DataFrame:
    """(media_id, interval_id, event_id): events that overlap an interval, edges included."""
    pairs = range_join(intervals, events.select(KEY, "event_id", "start_us", "end_us"), width=width)
    return pairs.select(KEY, "interval_id", F.col("r_event_id").alias("event_id")).distinct()


def _yes(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _latency(seconds: str) -> list[Column]:
    return [F.avg(seconds).alias("mean_s"), F.percentile(seconds, 0.5).alias("p50_s"), F.percentile(seconds, 0.9).alias("p90_s")]


def detection(said: DataFrame, pairs: DataFrame, intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """said(by, media_id, event_id, category): what was found in events -> for each of by and interval: detected (anything in an event
    that overlaps it) and category_detected (its own category). Every interval has a row for every value of by."""
    own = intervals.select(KEY, "interval_id", F.col("category").alias("wanted"))
    hits = said.join(pairs, [KEY, "event_id"]).join(own.select(KEY, "interval_id", "wanted"), [KEY, "interval_id"])
    found = hits.groupBy(*by, KEY, "interval_id").agg(F.lit(True).alias("detected"), F.bool_or(F.coalesce(F.col("category") == F.col("wanted"), F.lit(False))).alias("category_detected"))
    every = said.select(*by).distinct().join(own) if by else own
    return every.join(found, [*by, KEY, "interval_id"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("detected", "category_detected")})


def recall(detected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per by: intervals, those detected and with their category, and both recalls; null without intervals."""
    out = detected.groupBy(*by).agg(F.count("*").alias("n_intervals"), F.count_if("detected").alias("n_detected"), F.count_if("category_detected").alias("n_category_detected"))
    return out.withColumns({"recall": ratio(F.col("n_detected"), F.col("n_intervals")), "category_recall": ratio(F.col("n_category_detected"), F.col("n_intervals"))})


def binary_summary(answers: DataFrame, pairs: DataFrame, intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per variant: events, requests, answers by kind, their rates, interval recalls, latency and tokens. An event is unsafe if any
    question about it was answered yes."""
    out = answers.groupBy(*by).agg(F.count_distinct(F.struct(KEY, "event_id")).alias("n_events"), F.count("*").alias("n_requests"), _yes(F.col("answer") == "yes").alias("n_yes"), _yes(F.col("answer") == "no").alias("n_no"), F.count_if(F.col("answer").isNull()).alias("n_unverified"), *_latency("seconds"), F.sum("tokens").alias("tokens"))
    out = out.withColumns({"valid_rate": ratio(F.col("n_yes") + F.col("n_no"), F.col("n_requests")), "unverified_rate": ratio(F.col("n_unverified"), F.col("n_requests"))})
    # a variant without a yes has no row in what was found, and yet its intervals
    said = answers.where("answer = 'yes'").select(*by, KEY, "event_id", "category")
    nothing = answers.select(*by).distinct().select(*by, *[F.lit(None).cast(said.schema[c].dataType).alias(c) for c in (KEY, "event_id", "category")])
    return out.join(recall(detection(said.unionByName(nothing), pairs, intervals, by), by), list(by), "left")


def binary_by_category(answers: DataFrame, pairs: DataFrame, intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per variant and category: its intervals, those of which an overlapping event was answered yes for it, recall (null without
    intervals), the answers by kind, seconds and tokens."""
    out = answers.groupBy(*by, "category").agg(_yes(F.col("answer") == "yes").alias("n_yes"), _yes(F.col("answer") == "no").alias("n_no"), F.count_if(F.col("answer").isNull()).alias("n_unverified"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"))
    total = intervals.groupBy("category").agg(F.count("*").alias("n_intervals"))
    hits = answers.where("answer = 'yes'").join(pairs, [KEY, "event_id"]).join(intervals.select(KEY, "interval_id", "category"), [KEY, "interval_id", "category"])
    n = hits.groupBy(*by, "category").agg(F.count_distinct(F.struct(KEY, "interval_id")).alias("n_detected"))
    out = out.join(total, "category", "left").join(n, [*by, "category"], "left").na.fill(0, ["n_intervals", "n_detected"])
    return out.withColumn("recall", ratio(F.col("n_detected"), F.nullif(F.col("n_intervals"), F.lit(0))))


def bitmask_summary(masks: DataFrame, pairs: DataFrame, intervals: DataFrame, by: Sequence[str], answers: DataFrame | None = None) -> DataFrame:
    """Per variant: events, valid masks, events with and without categories, interval recalls and latency. answers (media_id,
    event_id, category, answer) of the same events: how many categories both judged (comparable), and where they disagree."""
    valid = F.col("categories").isNotNull()
    out = masks.groupBy(*by).agg(F.count("*").alias("n_events"), F.count_if(valid).alias("n_valid"), _yes(F.size("categories") > 0).alias("n_with"), _yes(valid & (F.size("categories") == 0)).alias("n_without"), F.count_if(~valid).alias("n_unverified"), *_latency("seconds"))
    out = out.withColumn("valid_rate", ratio(F.col("n_valid"), F.col("n_events")))
    said = masks.select(*by, KEY, "event_id", F.explode_outer("categories").alias("category"))
    said = said.withColumns({c: F.when(F.col("category").isNotNull(), F.col(c)) for c in (KEY, "event_id")})
    out = out.join(recall(detection(said, pairs, intervals, by), by), list(by), "left")
    if answers is None:
        return out
    both = masks.where(valid).select(*by, KEY, "event_id", "categories").join(answers.where("answer is not null").select(KEY, "event_id", "category", "answer"), [KEY, "event_id"])
    unlike = (F.col("answer") == "yes") != F.array_contains("categories", F.col("category"))
    counts = both.groupBy(*by).agg(F.count("*").alias("comparable"), F.count_if(unlike).alias("disagreements"))
    return out.join(counts, list(by), "left").na.fill(0, ["comparable", "disagreements"])


def quality_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """records(by, status, json_valid, schema_valid, n_frames, overlaps, retried, recovered): events by what their verdict says.

    status is verified_unsafe, verified_safe, unverified, or null for events whose frames were not resolved, which count as
    unverified too. Rates are over events with an attempt, null without; overlaps tells events that a labelled interval overlaps."""
    s, tried = F.col("status"), F.col("status").isNotNull()
    quiet = ~F.coalesce("overlaps", F.lit(False))
    out = records.groupBy(*by).agg(
        F.count("*").alias("n_events"), F.sum("n_frames").alias("n_frames"), F.count_if(tried).alias("n_resolved"), F.count_if(~tried).alias("n_unresolved"), _yes(s == "verified_unsafe").alias("n_unsafe"), _yes(s == "verified_safe").alias("n_safe"),
        F.count_if(~tried | (s == "unverified")).alias("n_unverified"), _yes(tried & F.col("json_valid")).alias("n_json"), _yes(tried & F.col("schema_valid")).alias("n_schema"), _yes(F.col("retried")).alias("n_retried"), _yes(F.col("retried") & F.col("recovered")).alias("n_recovered"),
        F.count_if(quiet).alias("n_unlabelled"), _yes(quiet & (s == "verified_unsafe")).alias("unlabelled_unsafe"), _yes(quiet & (s == "verified_safe")).alias("unlabelled_safe"), F.count_if(quiet & (~tried | (s == "unverified"))).alias("unlabelled_unverified"),
    )
    return out.withColumns({"json_rate": ratio(F.col("n_json"), F.col("n_resolved")), "schema_rate": ratio(F.col("n_schema"), F.col("n_resolved")), "completed_rate": ratio(F.col("n_unsafe") + F.col("n_safe"), F.col("n_resolved"))})


def unverified_reasons(records: DataFrame, by: Sequence[str] = (), unresolved: str = "unresolved_frame_reconstruction") -> DataFrame:
    """(by, reason, n): why events are unverified; those without an attempt have the reason unresolved."""
    rows = records.where("status is null or status = 'unverified'").withColumn("reason", F.when(F.col("status").isNull(), F.lit(unresolved)).otherwise(F.col("reason")))
    return rows.where("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def latency_by_group(records: DataFrame, by: Sequence[str], *, seconds: str, tokens: str | None = None, rates: Sequence[str] = ()) -> DataFrame:
    """Per group: n, p50, p90 and p95 (linear between ranks), mean and greatest seconds, mean tokens, and the share of each
    boolean column in rates."""
    more = [F.avg(tokens).alias("mean_tokens")] if tokens else []
    shares = [F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(f"{c}_rate") for c in rates]
    return records.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(seconds, q).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))], F.avg(seconds).alias("mean"), F.max(seconds).alias("most"), *more, *shares)


def batch_occupancy(items: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Per group, for batches of size: their number, full and partial ones, the size of the last, and the mean occupancy."""
    out = items.groupBy(*by).agg(F.count("*").alias("n"))
    batches, rest = F.ceil(F.col("n") / size).cast("bigint"), F.col("n") % size
    return out.select(*by, batches.alias("n_batches"), F.floor(F.col("n") / size).cast("bigint").alias("n_full"), (rest > 0).cast("bigint").alias("n_partial"), F.when(rest == 0, size).otherwise(rest).cast("bigint").alias("last_size"), ratio(F.col("n"), batches * size).alias("occupancy"))


def gate(rows: DataFrame, summary: DataFrame, rule: Column) -> DataFrame:
    """All rows if the summary, which has one row, keeps the rule; none if it does not, has another value than true, or no row."""
    ok = summary.agg(F.coalesce(F.bool_and(rule), F.lit(False)).alias("__ok"))
    return rows.join(F.broadcast(ok), F.col("__ok")).drop("__ok")


def ordinal_ids(rows: DataFrame, order: Sequence[str], *, form: str = "event:%04d", key: Sequence[str] = (KEY,), name: str = "id") -> DataFrame:
    """rows with an id by their place in the order, from 0, in each timeline."""
    from pyspark.sql import Window

    return rows.withColumn(name, F.format_string(form, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1))


def min_gap_violations(intervals: DataFrame, gap: int, by: Sequence[str], *, ident: str = "interval_id") -> DataFrame:
    """Intervals that start less than gap behind the end of the one before of the same by (its greatest end so far is not asked)."""
    from pyspark.sql import Window

    before = F.lag("end_us").over(Window.partitionBy(*by).orderBy("start_us", ident))
    return intervals.withColumn("__p", before).where(F.col("start_us") - F.col("__p") < gap).drop("__p")


def results_lookup(rows: DataFrame, *, where: Column, order: Sequence[Column | str], least: tuple[str, float] | None = None) -> DataFrame:
    """Stored results under a condition, and with least (column, value) those that reach it, nulls never; in order."""
    out = rows.where(where)
    if least:
        out = out.where(F.coalesce(F.col(least[0]) >= least[1], F.lit(False)))
    return out.orderBy(*order)


def oldest_by_path(rows: DataFrame, path: str, age: str, ident: str, by: Sequence[str] = ()) -> DataFrame:
    """For each path, whatever its case, the row of the least age (of equals the least ident)."""
    folded = F.lower(F.col(path)).alias(path)
    return rows.groupBy(*by, folded).agg(F.min(F.struct(F.col(age).alias("age"), F.col(ident).alias("ident"))).alias("m")).select(*by, path, F.col("m.ident").alias(ident))


def prompt_ranking(scores: DataFrame, by: str, score: Column, quantile: float = 0.99) -> DataFrame:
    """Groups by falling quantile of a score, nulls last, ties by name, with their place. Groups are few: prompts or concepts."""
    from pyspark.sql import Window

    q = scores.groupBy(by).agg(F.percentile(score, quantile).alias("q"))
    return q.withColumn("place", F.row_number().over(Window.orderBy(F.col("q").desc_nulls_last(), by)))


def first_at_or_after(points: DataFrame, at: int, *, ts: str = "ts_us", key: Sequence[str] = (KEY,)) -> DataFrame:
    """Each timeline's first time at or after a moment; null where none is left."""
    return points.groupBy(*key).agg(F.min(F.when(F.col(ts) >= at, F.col(ts))).alias(ts))
