"""Queries of model verdicts: predictions as events that were asked about each category, truth as labelled intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verdicts as vs
from .registry import register
from .standins import duck, standin

_CATS = ("red", "green", "blue")
_ANSWERS = """an AS (SELECT media_id, interval_id AS event_id, 'v' || interval_id % 2 AS variant, c AS category, CASE WHEN (interval_id + i) % 11 = 0 THEN NULL WHEN c = category OR confidence >= 0.3 THEN 'yes' ELSE 'no' END AS answer, interval_id % 100 / 10.0::DOUBLE AS seconds, interval_id % 7 + i AS tokens FROM (SELECT *, unnest(['red', 'green', 'blue']) AS c, unnest([0, 1, 2]) AS i FROM predicted)),
pr AS (SELECT DISTINCT t.media_id, t.interval_id, p.interval_id AS event_id FROM truth t JOIN predicted p ON p.media_id = t.media_id AND t.start_us <= p.end_us AND p.start_us <= t.end_us),
dt AS (SELECT v.variant, t.media_id, t.interval_id, bool_or(coalesce(a.category IS NOT NULL, false)) AS d, bool_or(coalesce(a.category = t.category, false)) AS c FROM (SELECT DISTINCT variant FROM an) v CROSS JOIN truth t LEFT JOIN pr ON pr.media_id = t.media_id AND pr.interval_id = t.interval_id LEFT JOIN an a ON a.media_id = pr.media_id AND a.event_id = pr.event_id AND a.variant = v.variant AND a.answer = 'yes' GROUP BY 1, 2, 3)"""


def _answers(spark, d):
    p = standin(spark, d, "predicted")
    asked = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(i).alias("i")) for i, c in enumerate(_CATS)])).alias("x")
    rows = p.select("media_id", F.col("interval_id").alias("event_id"), "category", "confidence", asked).select("*", "x.*")
    n = F.col("event_id")
    answer = F.when((n + F.col("i")) % 11 == 0, None).when((F.col("c") == F.col("category")) | (F.col("confidence") >= 0.3), "yes").otherwise("no")
    return rows.select("media_id", "event_id", F.concat(F.lit("v"), (n % 2).cast("string")).alias("variant"), F.col("c").alias("category"), answer.alias("answer"), (n % 100 / 10.0).cast("double").alias("seconds"), (n % 7 + F.col("i")).alias("tokens"))


def _parts(spark, d):
    from .standins import HOUR

    events = standin(spark, d, "predicted").withColumnRenamed("interval_id", "event_id")
    t = standin(spark, d, "truth")
    return vs.interval_pairs(events, t, width=4 * HOUR), t.select("media_id", "interval_id", "category")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_RATES = ("mean_s", "p50_s", "p90_s", "valid_rate", "unverified_rate", "recall", "category_recall")


@register("a14_binary_summary", duck("""SELECT variant, n_events, n_requests, n_yes, n_no, n_unverified, mean_s, p50_s, p90_s, tokens, round((n_yes + n_no) / n_requests, 6) AS valid_rate, round(n_unverified / n_requests, 6) AS unverified_rate, n_intervals, n_detected, n_category_detected, round(n_detected / n_intervals, 6) AS recall, round(n_category_detected / n_intervals, 6) AS category_recall
 FROM (SELECT variant, count(DISTINCT (media_id, event_id)) AS n_events, count(*) AS n_requests, count(*) FILTER (answer = 'yes') AS n_yes, count(*) FILTER (answer = 'no') AS n_no, count(*) FILTER (answer IS NULL) AS n_unverified, round(avg(seconds), 6) AS mean_s, round(quantile_cont(seconds, 0.5), 6) AS p50_s, round(quantile_cont(seconds, 0.9), 6) AS p90_s, sum(tokens)::BIGINT AS tokens FROM an GROUP BY 1)
 JOIN (SELECT variant, count(*) AS n_intervals, count(*) FILTER (d) AS n_detected, count(*) FILTER (c) AS n_category_detected FROM dt GROUP BY 1) USING (variant)""", _ANSWERS))
def _(spark, d):
    return _rounded(vs.binary_summary(_answers(spark, d), *_parts(spark, d), ["variant"]), *_RATES)


@register("a14_binary_by_category", duck("""SELECT a.variant, a.category, n_yes, n_no, n_unverified, round(seconds, 6) AS seconds, tokens, n_intervals, coalesce(n_detected, 0) AS n_detected, round(coalesce(n_detected, 0) / n_intervals, 6) AS recall FROM (SELECT variant, category, count(*) FILTER (answer = 'yes') AS n_yes, count(*) FILTER (answer = 'no') AS n_no, count(*) FILTER (answer IS NULL) AS n_unverified, sum(seconds) AS seconds, sum(tokens)::BIGINT AS tokens FROM an GROUP BY 1, 2) a
 JOIN (SELECT category, count(*) AS n_intervals FROM truth GROUP BY 1) t ON t.category = a.category LEFT JOIN (SELECT variant, t.category, count(DISTINCT (t.media_id, t.interval_id)) AS n_detected FROM an JOIN pr ON pr.media_id = an.media_id AND pr.event_id = an.event_id JOIN truth t ON t.media_id = pr.media_id AND t.interval_id = pr.interval_id AND t.category = an.category WHERE answer = 'yes' GROUP BY 1, 2) h ON h.variant = a.variant AND h.category = a.category""", _ANSWERS))
def _(spark, d):
    return _rounded(vs.binary_by_category(_answers(spark, d), *_parts(spark, d), ["variant"]), "seconds", "recall")


_MASKS = f"""{_ANSWERS}, mk AS (SELECT media_id, event_id, variant, CASE WHEN event_id % 13 > 0 THEN list_sort(list(category) FILTER (answer = 'yes' AND event_id % 3 > 0)) END AS cats, max(seconds) AS seconds, event_id % 13 > 0 AS ok FROM an GROUP BY media_id, event_id, variant),
mv AS (SELECT media_id, event_id, variant, seconds, CASE WHEN ok THEN coalesce(cats, []) END AS cats FROM mk),
md AS (SELECT v.variant, t.media_id, t.interval_id, bool_or(coalesce(len(cats) > 0, false)) AS d, bool_or(coalesce(list_contains(cats, t.category), false)) AS c FROM (SELECT DISTINCT variant FROM mv) v CROSS JOIN truth t LEFT JOIN pr ON pr.media_id = t.media_id AND pr.interval_id = t.interval_id LEFT JOIN mv a ON a.media_id = pr.media_id AND a.event_id = pr.event_id AND a.variant = v.variant GROUP BY 1, 2, 3)"""


@register("a14_bitmask_summary", duck("""SELECT variant, n_events, n_valid, n_with, n_without, n_unverified, mean_s, p50_s, p90_s, round(n_valid / n_events, 6) AS valid_rate, n_intervals, n_detected, n_category_detected, round(n_detected / n_intervals, 6) AS recall, round(n_category_detected / n_intervals, 6) AS category_recall, coalesce(comparable, 0) AS comparable, coalesce(disagreements, 0) AS disagreements
 FROM (SELECT variant, count(*) AS n_events, count(cats) AS n_valid, count(*) FILTER (len(cats) > 0) AS n_with, count(*) FILTER (len(cats) = 0) AS n_without, count(*) FILTER (cats IS NULL) AS n_unverified, round(avg(seconds), 6) AS mean_s, round(quantile_cont(seconds, 0.5), 6) AS p50_s, round(quantile_cont(seconds, 0.9), 6) AS p90_s FROM mv GROUP BY 1)
 JOIN (SELECT variant, count(*) AS n_intervals, count(*) FILTER (d) AS n_detected, count(*) FILTER (c) AS n_category_detected FROM md GROUP BY 1) USING (variant)
 LEFT JOIN (SELECT mv.variant, count(*) AS comparable, count(*) FILTER ((answer = 'yes') <> list_contains(cats, category)) AS disagreements FROM mv JOIN an ON an.media_id = mv.media_id AND an.event_id = mv.event_id WHERE cats IS NOT NULL AND answer IS NOT NULL GROUP BY 1) USING (variant)""", _MASKS))
def _(spark, d):
    a, n = _answers(spark, d), F.col("event_id")
    said = F.collect_list(F.when((F.col("answer") == "yes") & (n % 3 > 0), F.col("category")))
    masks = a.groupBy("media_id", "event_id", "variant").agg(F.when(n % 13 > 0, said).alias("categories"), F.max("seconds").alias("seconds"))
    return _rounded(vs.bitmask_summary(masks, *_parts(spark, d), ["variant"], answers=a), *[c for c in _RATES if c != "unverified_rate"])


_STATUS = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unverified' WHEN 2 THEN 'verified_safe' ELSE 'verified_unsafe' END"
_QUALITY = f"""{_ANSWERS}, ql AS (SELECT media_id, interval_id AS event_id, 'v' || interval_id % 2 AS variant, {_STATUS.replace('event_id', 'interval_id')} AS status, CASE WHEN interval_id % 3 = 0 THEN 'empty' WHEN interval_id % 3 = 1 THEN 'schema' END AS reason, interval_id % 4 > 0 AS json_valid, interval_id % 6 > 0 AS schema_valid, interval_id % 6 AS n_frames, interval_id % 8 = 1 AS retried, interval_id % 16 = 1 AS recovered,
  EXISTS (SELECT 1 FROM pr WHERE pr.media_id = predicted.media_id AND pr.event_id = predicted.interval_id) AS ov FROM predicted)"""


def _quality(spark, d):
    n, f = F.col("event_id"), F.col
    pairs = _parts(spark, d)[0].select("media_id", "event_id").distinct().withColumn("overlaps", F.lit(True))
    rows = standin(spark, d, "predicted").withColumnRenamed("interval_id", "event_id").join(pairs, ["media_id", "event_id"], "left")
    return rows.select("media_id", "event_id", F.concat(F.lit("v"), (n % 2).cast("string")).alias("variant"), F.expr(_STATUS).alias("status"), F.when(n % 3 == 0, "empty").when(n % 3 == 1, "schema").alias("reason"), (n % 4 > 0).alias("json_valid"), (n % 6 > 0).alias("schema_valid"), (n % 6).alias("n_frames"), (n % 8 == 1).alias("retried"), (n % 16 == 1).alias("recovered"), f("overlaps"))


@register("a14_quality_summary", duck("""SELECT variant, count(*) AS n_events, sum(n_frames)::BIGINT AS n_frames, count(status) AS n_resolved, count(*) - count(status) AS n_unresolved, count(*) FILTER (status = 'verified_unsafe') AS n_unsafe, count(*) FILTER (status = 'verified_safe') AS n_safe, count(*) FILTER (status IS NULL OR status = 'unverified') AS n_unverified, count(*) FILTER (status IS NOT NULL AND json_valid) AS n_json, count(*) FILTER (status IS NOT NULL AND schema_valid) AS n_schema,
 count(*) FILTER (retried) AS n_retried, count(*) FILTER (retried AND recovered) AS n_recovered, count(*) FILTER (NOT ov) AS n_unlabelled, count(*) FILTER (NOT ov AND status = 'verified_unsafe') AS unlabelled_unsafe, count(*) FILTER (NOT ov AND status = 'verified_safe') AS unlabelled_safe, count(*) FILTER (NOT ov AND (status IS NULL OR status = 'unverified')) AS unlabelled_unverified,
 round(count(*) FILTER (status IS NOT NULL AND json_valid) / count(status), 6) AS json_rate, round(count(*) FILTER (status IS NOT NULL AND schema_valid) / count(status), 6) AS schema_rate, round(count(*) FILTER (status LIKE 'verified%') / count(status), 6) AS completed_rate FROM ql GROUP BY 1""", _QUALITY))
def _(spark, d):
    return _rounded(vs.quality_summary(_quality(spark, d), ["variant"]), "json_rate", "schema_rate", "completed_rate")


@register("a14_unverified_reasons", duck("SELECT variant, CASE WHEN status IS NULL THEN 'unresolved_frame_reconstruction' ELSE reason END AS reason, count(*) AS n FROM ql WHERE status IS NULL OR (status = 'unverified' AND reason IS NOT NULL) GROUP BY 1, 2", _QUALITY))
def _(spark, d):
    return vs.unverified_reasons(_quality(spark, d), ["variant"])
