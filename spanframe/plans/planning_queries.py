"""Queries of candidate planning, fusion and policy evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import planning as pl
from ..operators import policy as po
from .registry import register
from .standins import HOUR, MINUTE, duck, merged, standin

_GRID = [(a, b) for a in (0.05, 0.1, 0.2, 0.3, 0.5) for b in (0.5, 0.8, 0.95, 0.99)]
_GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _GRID) + ") g(t_a, t_b))"


def _samples(spark, d):
    return standin(spark, d, "samples").withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double")})


def _grid(spark):
    return spark.createDataFrame(_GRID, "t_a double, t_b double")


@register("p01_candidate_mask", duck("SELECT media_id, sample_id FROM samples WHERE a >= 0.2 OR b >= 0.9"))
def _(spark, d):
    return pl.candidate_mask(_samples(spark, d), 0.2, 0.9).select("media_id", "sample_id")


@register("p02_prefilter_gate", duck("SELECT media_id, sample_id FROM samples WHERE a >= CASE WHEN media_id % 2 = 0 THEN 0.45 ELSE 0.15 END OR sample_id % 50 = 0"))
def _(spark, d):
    rows = _samples(spark, d).withColumn("included", F.col("sample_id") % 50 == 0)
    return pl.prefilter_gate(rows, F.when(F.col("media_id") % 2 == 0, "fast").otherwise("thorough")).select("media_id", "sample_id")


@register("p03_semantic_trigger", duck("SELECT media_id, sample_id, NOT scene AND (a >= 0.2 OR b >= 0.9) AS triggered FROM samples"))
def _(spark, d):
    return pl.semantic_trigger(_samples(spark, d).withColumn("available", ~F.col("scene")), 0.2, 0.9).select("media_id", "sample_id", "triggered")


@register("p04_detector_tags", duck("SELECT media_id, list_filter([CASE WHEN x THEN 'a' END, CASE WHEN y THEN 'b' END], lambda t: t IS NOT NULL) AS tags, CASE WHEN x AND y THEN 'both' WHEN x THEN 'a_only' WHEN y THEN 'b_only' ELSE 'none' END AS profile FROM (SELECT media_id, bool_or(a >= 0.5) AS x, bool_or(b >= 0.99) AS y FROM samples GROUP BY 1)"), arrays=("tags",))
def _(spark, d):
    return pl.detector_tags(_samples(spark, d), {"a": F.col("a") >= 0.5, "b": F.col("b") >= 0.99}, ["media_id"])


def _half(b):
    import pyarrow.compute as pc

    return pc.multiply(b.column("a"), 0.5)


def _no_score(b):
    raise LookupError("no model")


@register("c01_score", duck("SELECT media_id, sample_id, CASE WHEN sample_id % 7 > 0 THEN a::DOUBLE * 0.5 ELSE 1.0 END AS probability, sample_id % 7 = 0 AS included, CASE WHEN sample_id % 7 = 0 THEN 'LookupError' END AS error FROM samples"))
def _(spark, d):
    """A scorer that works for most samples, and one that fails at every batch for the others."""
    rows = _samples(spark, d).select("media_id", "sample_id", F.col("a").cast("double").alias("a"))
    out = pl.score(rows.where("sample_id % 7 > 0"), _half).union(pl.score(rows.where("sample_id % 7 = 0"), _no_score))
    return out.drop("a")


@register("c01_score_diagnostics", duck("SELECT count(*) FILTER (sample_id % 7 = 0) > 0 AS any_failed, count(*) FILTER (sample_id % 7 = 0) AS included, count(*) FILTER (sample_id % 7 = 0) AS n_rows, 0::BIGINT AS scored, true AS every_batch_failed FROM samples"))
def _(spark, d):
    from pyspark.sql import Observation

    seen = Observation("score")
    pl.score(_samples(spark, d).where("sample_id % 7 = 0").select("media_id", "sample_id"), _no_score, observation=seen).write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["failed_batches"] > 0, got["included"], got["rows"], got["scored"], got["failed_batches"] == got["batches"])], "any_failed boolean, included bigint, n_rows bigint, scored bigint, every_batch_failed boolean")


_BANK = "(SELECT label AS concept, arg_min(embedding, vec_id) AS prompt FROM embeddings GROUP BY label)"
_COS = f"cs AS (SELECT e.vec_id, concept, list_cosine_similarity(e.embedding::DOUBLE[], prompt::DOUBLE[]) AS cosine FROM embeddings e, {_BANK})"


def _concepts(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    bank = e.groupBy(F.col("label").alias("concept")).agg(F.min_by("embedding", "vec_id").alias("prompt"))
    return pl.concept_scores(e.select("vec_id", F.col("embedding").alias("vector")), bank)


@register("c02_concept_scores", f"WITH {_COS} SELECT vec_id, concept, round(cosine, 6) AS cosine, round(100 * cosine, 4) AS logit FROM cs")
def _(spark, d):
    return _concepts(spark, d).select("vec_id", "concept", F.round("cosine", 6).alias("cosine"), F.round("logit", 4).alias("logit"))


_STRATEGIES = f"WITH {_COS} SELECT vec_id, round(pos_max, 6) AS pos_max, round(pos_mean, 6) AS pos_mean, round(control_max, 6) AS control_max, round(pos_max - control_max, 6) AS max_margin, round(pos_mean - control_max, 6) AS mean_margin FROM (SELECT vec_id, max(cosine) FILTER (concept < 5) AS pos_max, avg(cosine) FILTER (concept < 5) AS pos_mean, max(cosine) FILTER (concept >= 7) AS control_max FROM cs GROUP BY 1)"


@register("a07_score_concepts", _STRATEGIES)
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    bank = e.groupBy(F.col("label").alias("concept")).agg(F.min_by("embedding", "vec_id").alias("prompt"))
    out = pl.score_concepts(e, bank, range(5), range(7, 10), ident="vec_id", vector="embedding")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@register("a07_concept_strategies", _STRATEGIES)
def _(spark, d):
    out = pl.concept_strategies(_concepts(spark, d), range(5), range(7, 10), ["vec_id"])
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_LEX = [(1, "red", 0.9, "thst"), (2, "green", 0.9, "ndre"), (3, "blue", 0.6, "the "), (4, "red", 0.3, "a")]
_LEX_SQL = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, '{c}', {x}::DOUBLE, '{p}')" for r, c, x, p in _LEX) + ") l(rank, category, confidence, pattern))"
_TEXT = f"said AS (SELECT media_id, start_us, end_us, category, confidence FROM (SELECT *, row_number() OVER (PARTITION BY media_id, start_us ORDER BY confidence DESC, rank) AS n FROM segments, lex WHERE contains(lower(text), pattern)) WHERE n = 1 AND confidence >= 0.5)"


def _said(spark, d):
    lexicon = spark.createDataFrame(_LEX, "rank int, category string, confidence double, pattern string")
    return pl.text_evidence(standin(spark, d, "segments"), lexicon, least=0.5, ident=("media_id", "start_us"))


@register("c03_text_evidence", duck("SELECT * FROM said", f"{_LEX_SQL}, {_TEXT}"))
def _(spark, d):
    return _said(spark, d).select("media_id", "start_us", "end_us", "category", "confidence")


@register("c04_text_windows", duck("SELECT media_id, start_us, end_us, 0.0::DOUBLE AS peak, [(start_us + end_us) // 2] AS evidence_us, 'text' AS trigger FROM said", f"{_LEX_SQL}, {_TEXT}"), arrays=("evidence_us",))
def _(spark, d):
    return pl.text_windows(_said(spark, d)).select("media_id", "start_us", "end_us", "peak", "evidence_us", "trigger")


_WINDOWS = f"""seeds AS (SELECT media_id, ts_us AS start_us, ts_us AS end_us, a::DOUBLE AS peak, [ts_us] AS ev, true AS seen, false AS said FROM samples WHERE a >= 0.15 OR sample_id % 50 = 0
  UNION ALL SELECT media_id, start_us, end_us, 0.0, [(start_us + end_us) // 2], false, true FROM truth WHERE end_us > start_us),
one AS {merged('seeds', 5 * HOUR, ', max(peak) AS peak, flatten(list(ev)) AS ev, bool_or(seen) AS seen, bool_or(said) AS said')},
padded AS (SELECT o.media_id, greatest(0, start_us - {HOUR}) AS start_us, least(duration_us, end_us + {HOUR}) AS end_us, peak, ev, seen, said FROM one o JOIN media m ON o.media_id = m.media_id),
two AS {merged('padded', 0, ', max(peak) AS peak, flatten(list(ev)) AS ev, bool_or(seen) AS seen, bool_or(said) AS said')},
pieces AS (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(1, ceil((end_us - start_us) / {12 * HOUR}))::BIGINT AS n FROM two)),
cut AS (SELECT *, start_us + i * {12 * HOUR} AS lo, CASE WHEN i = n - 1 THEN end_us ELSE start_us + (i + 1) * {12 * HOUR} END AS hi FROM pieces),
windows AS (SELECT media_id, printf('candidate-%05d', row_number() OVER (PARTITION BY media_id ORDER BY lo) - 1) AS window_id, lo AS start_us, hi AS end_us, peak,
  list_sort(list_distinct(list_filter(ev, lambda t: t >= lo AND (t < hi OR (i = n - 1 AND t <= hi))))) AS evidence_us, CASE WHEN seen AND said THEN 'visual_and_text' WHEN said THEN 'text' ELSE 'visual' END AS trigger FROM cut)"""


def windows(spark, d):
    scores = _samples(spark, d).withColumn("included", F.col("sample_id") % 50 == 0)
    return pl.group_candidate_windows(scores, pl.text_windows(standin(spark, d, "truth")), standin(spark, d, "media"), threshold=0.15, gap=5 * HOUR, pad=HOUR, longest=12 * HOUR)


@register("c05_candidate_windows", duck("SELECT media_id, window_id, start_us, end_us, round(peak, 9) AS peak, evidence_us, trigger FROM windows", _WINDOWS), arrays=("evidence_us",))
def _(spark, d):
    return windows(spark, d).withColumn("peak", F.round("peak", 9))


@register("window_workload", duck("SELECT w.media_id, count(*) AS n_windows, sum(end_us - start_us)::BIGINT AS covered_us, round(sum(end_us - start_us) / max(duration_us), 9) AS share FROM windows w JOIN media m ON w.media_id = m.media_id GROUP BY 1", _WINDOWS))
def flagship(spark, d):
    out = windows(spark, d).join(standin(spark, d, "media"), "media_id").groupBy("media_id")
    length = F.col("end_us") - F.col("start_us")
    return out.agg(F.count("*").alias("n_windows"), F.sum(length).alias("covered_us"), F.round(F.sum(length) / F.max("duration_us"), 9).alias("share"))


@register("c06_union_candidates", duck("SELECT media_id, sample_id, a >= 0.2 AS by_a, coalesce(CASE WHEN NOT scene THEN b END >= 0.9, false) AS by_b FROM samples WHERE a >= 0.2 OR (NOT scene AND b >= 0.9)"))
def _(spark, d):
    return pl.union_candidates(_samples(spark, d), 0.2, 0.9, ~F.col("scene")).select("media_id", "sample_id", "by_a", "by_b")


_CLUSTER = """c AS (SELECT media_id, sample_id, ts_us, duration_us, a >= 0.1 AS by_a, b >= 0.6 AS by_b FROM samples WHERE a >= 0.1 OR b >= 0.6),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) AS island FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) > {gap} THEN 1 ELSE 0 END AS fresh FROM c)),
l AS (SELECT media_id, island, list(ts_us ORDER BY ts_us, sample_id) AS t FROM g GROUP BY 1, 2),
parts AS (WITH RECURSIVE p AS (SELECT media_id, island, t FROM l UNION ALL SELECT media_id, island, unnest([t[:k], t[k+1:]]) FROM (SELECT media_id, island, t, list_position(d, list_max(d)) AS k FROM
  (SELECT media_id, island, t, list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i]) AS d FROM p WHERE len(t) > 1 AND t[len(t)] - t[1] + {ctx2} > {longest})))
  SELECT * FROM p WHERE len(t) = 1 OR t[len(t)] - t[1] + {ctx2} <= {longest})""".format(gap=12 * HOUR, ctx2=4 * HOUR, longest=24 * HOUR)


def _clusters(spark, d):
    rows = _samples(spark, d).withColumns({"by_a": F.col("a") >= 0.1, "by_b": F.col("b") >= 0.6}).where("by_a or by_b")
    return pl.cluster_events(rows, gap=12 * HOUR, context=2 * HOUR, longest=24 * HOUR)


@register("c07_cluster_events", duck(f"SELECT p.media_id, t[1] AS first_us, t[len(t)] AS last_us, len(t) AS n_samples, greatest(0, t[1] - {2 * HOUR}) AS start_us, least(duration_us, t[len(t)] + {2 * HOUR}) AS end_us FROM parts p JOIN media m ON p.media_id = m.media_id", _CLUSTER))
def _(spark, d):
    return _clusters(spark, d).select("media_id", "first_us", "last_us", "n_samples", "start_us", "end_us")


_FUSE = f"""v AS (SELECT p.*, coalesce(tc, 0.0) AS tc, coalesce(ag, false) AS ag FROM predicted p LEFT JOIN (SELECT p.media_id, p.interval_id, max(t.conf) AS tc, bool_or(p.category = t.category) AS ag FROM predicted p JOIN
  (SELECT *, ((interval_id * 31) % 100) / 100.0 AS conf FROM truth) t ON p.media_id = t.media_id AND t.start_us <= p.end_us + {HOUR} AND p.start_us <= t.end_us + {HOUR} WHERE t.conf >= 0.3 GROUP BY 1, 2) x ON p.media_id = x.media_id AND p.interval_id = x.interval_id WHERE confidence >= 0.02),
f AS (SELECT media_id, interval_id, greatest(0, start_us - {HOUR}) AS start_us, least(duration_us, end_us + {HOUR}) AS end_us, category, confidence::DOUBLE AS confidence, tc::DOUBLE AS tc, least(1.0, confidence + (1 - confidence) * 0.12 * tc + CASE WHEN ag THEN (1 - confidence) * 0.04 ELSE 0 END)::DOUBLE AS final, (start_us + end_us) // 2 AS mid FROM v)"""


@register("c08_fuse_evidence", duck(f"SELECT media_id, start_us, end_us, category, round(vc, 4) AS visual_confidence, round(tc, 4) AS text_confidence, round(fc, 4) AS final_confidence, ev AS evidence_us FROM {merged('f', 2 * HOUR, ', arg_max(category, (confidence, category, final)) AS category, max(confidence) AS vc, max(tc) AS tc, max(final) AS fc, list_sort(list_distinct(list(mid))) AS ev')}", _FUSE), arrays=("evidence_us",))
def _(spark, d):
    visual = standin(spark, d, "predicted").drop("duration_us").withColumns({"confidence": F.col("confidence").cast("double"), "reason": F.concat(F.lit("r"), F.col("interval_id") % 5)})
    text = standin(spark, d, "truth").withColumn("confidence", (F.col("interval_id") * 31 % 100) / 100.0)
    out = pl.fuse_evidence(visual, text, standin(spark, d, "media"), t_visual=0.02, t_text=0.3, gap=2 * HOUR, pad=HOUR, width=4 * HOUR, tol=HOUR)
    return out.select("media_id", "start_us", "end_us", "category", "visual_confidence", "text_confidence", "final_confidence", "evidence_us")


@register("c09_review_status", duck("SELECT media_id, CASE WHEN count(*) FILTER (event_type = 'error') > 10 THEN 'partial' ELSE 'completed' END AS status FROM samples GROUP BY 1"))
def _(spark, d):
    w = Window.partitionBy("media_id").orderBy("ts_us", "sample_id")
    errors = standin(spark, d, "samples").withColumn("n", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w))
    return pl.review_status(errors.withColumn("error", F.when(F.col("n") > 10, "too many")), ["media_id"])


def _fill(name, before):
    """One more time for each event: the one farthest from those taken, the earlier of equals."""
    rest = "list_filter(every, lambda x: NOT list_contains(taken, x))"
    far = f"list_reverse_sort(list_transform({rest}, lambda x: {{'d': list_min(list_transform(taken, lambda y: abs(x - y))), 't': -x}}))"
    return f"{name} AS (SELECT media_id, day, every, CASE WHEN len(taken) >= 6 OR len({rest}) = 0 THEN taken ELSE list_append(taken, -{far}[1].t) END AS taken FROM {before})"


_FRAMES = f"""k0 AS (SELECT media_id, ts_us // {72 * HOUR} AS day, list_sort(list(DISTINCT ts_us)) AS every, arg_max(ts_us, (a::DOUBLE, -ts_us)) AS ma, arg_max(ts_us, (b::DOUBLE, -ts_us)) AS mb FROM samples GROUP BY 1, 2),
k1 AS (SELECT media_id, day, every, list_distinct([ma, mb, every[1], every[-1]]) AS taken FROM k0), {", ".join(_fill(f"k{i + 1}", f"k{i}") for i in range(1, 7))}"""


@register("t05_select_event_frames", duck("SELECT media_id, day, list_sort(taken[1:6]) AS frames FROM k7", _FRAMES), arrays=("frames",))
def _(spark, d):
    return pl.select_event_frames(_samples(spark, d).withColumn("day", F.floor(F.col("ts_us") / (72 * HOUR))), ["media_id", "day"])


@register("t08_top_reasons", duck("SELECT media_id, array_to_string(list(r ORDER BY c DESC, i)[1:2], '; ') AS reason FROM (SELECT media_id, 'r' || (interval_id % 3) AS r, max(confidence) AS c, arg_min(interval_id, (-confidence, interval_id)) AS i FROM predicted GROUP BY 1, 2) GROUP BY 1"))
def _(spark, d):
    rows = standin(spark, d, "predicted").withColumn("reason", F.concat(F.lit("r"), F.col("interval_id") % 3))
    return pl.top_reasons(rows, ["media_id"])


_MAX = f"""mx AS (SELECT t.media_id, t.interval_id, t.category, t.severity, max(a::DOUBLE) FILTER (ts_us BETWEEN t.start_us AND t.end_us) AS a_in, max(b::DOUBLE) FILTER (ts_us BETWEEN t.start_us AND t.end_us) AS b_in, max(a::DOUBLE) AS a_near, max(b::DOUBLE) AS b_near FROM truth t LEFT JOIN samples s
 ON s.media_id = t.media_id AND s.event_type <> 'error' AND ts_us BETWEEN t.start_us - {HOUR} AND t.end_us + {HOUR} GROUP BY 1, 2, 3, 4),
shown AS (SELECT * FROM samples WHERE event_type <> 'error'),
table1 AS (SELECT r.*, n_samples, n_candidates, detected / n_intervals AS recall, detected_near / n_intervals AS recall_near, n_candidates / n_samples AS candidate_rate FROM (SELECT t_a, t_b, count(*) AS n_intervals, count(*) FILTER (coalesce(a_in >= t_a, false) OR coalesce(b_in >= t_b, false)) AS detected, count(*) FILTER (coalesce(a_near >= t_a, false) OR coalesce(b_near >= t_b, false)) AS detected_near FROM mx, grid GROUP BY 1, 2) r
 JOIN (SELECT t_a, t_b, count(*) AS n_samples, count(*) FILTER (a::DOUBLE >= t_a OR b::DOUBLE >= t_b) AS n_candidates FROM shown, grid GROUP BY 1, 2) c ON r.t_a = c.t_a AND r.t_b = c.t_b)"""
_TABLE = f"{_GRID_SQL}, {_MAX}"
_RATES = ("recall", "recall_near", "candidate_rate")


def _shown(spark, d):
    return _samples(spark, d).where("event_type <> 'error'")


def _table(spark, d):
    return po.evaluate_thresholds(_shown(spark, d), standin(spark, d, "truth"), _grid(spark), tol=HOUR, width=4 * HOUR)


@register("e01_evaluate_thresholds", duck("SELECT t_a, t_b, n_intervals, detected, detected_near, n_samples, n_candidates, round(recall, 9) AS recall, round(recall_near, 9) AS recall_near, round(candidate_rate, 9) AS candidate_rate FROM table1", _TABLE))
def _(spark, d):
    return _table(spark, d).withColumns({c: F.round(c, 9) for c in _RATES})


@register("e02_observed_threshold_grid", duck("SELECT DISTINCT a::DOUBLE AS threshold FROM (SELECT a, row_number() OVER (ORDER BY a) - 1 AS r, count(*) OVER () AS n FROM samples) JOIN (SELECT unnest(range(21)) AS i) ON r = round_even(i * (n - 1) / 20.0, 0)"))
def _(spark, d):
    return po.observed_threshold_grid(_samples(spark, d), "a", 21)


_E6 = f"""st AS (SELECT g AS gap, unnest([0, g // 3, g // 3 * 2]) AS phase FROM (SELECT unnest([{12 * HOUR}, {24 * HOUR}, {96 * HOUR}]) AS g)),
kept AS (SELECT * FROM (SELECT media_id, ts_us, a, gap, phase, floor((ts_us - phase) / gap) AS slot, coalesce(lag(floor((ts_us - phase) / gap)) OVER (PARTITION BY media_id, gap, phase ORDER BY ts_us, sample_id), -1) AS p FROM samples, st) WHERE slot >= 0 AND slot > p),
ph AS (SELECT k.gap, k.phase, count(*) AS retained, (SELECT count(DISTINCT (t.media_id, t.interval_id)) FROM kept h JOIN truth t ON t.media_id = h.media_id AND h.ts_us BETWEEN t.start_us AND t.end_us WHERE h.gap = k.gap AND h.phase = k.phase AND h.a >= 0.05) AS detected FROM kept k GROUP BY 1, 2)"""


def _phases(spark, d):
    settings = [(g * HOUR, p * g * HOUR // 3) for g in (12, 24, 96) for p in range(3)]
    return po.sampling_robustness(_samples(spark, d), standin(spark, d, "truth"), settings=settings, t_a=0.05, width=4 * HOUR)


@register("e06_sampling_phases", duck("SELECT gap, phase, retained, detected FROM ph", _E6))
def _(spark, d):
    return _phases(spark, d)


@register("e06_sampling_robustness", duck("SELECT gap, count(*) AS n_phases, min(detected) AS least_detected, max(detected) AS most_detected, min(retained) AS least_retained, max(retained) AS most_retained, round(avg(retained), 6) AS mean_retained, count(*) FILTER (detected < 50) AS failing_phases, min(phase) FILTER (detected < 50) AS first_failing_phase, round(count(*) FILTER (detected >= 50) / count(*), 6) AS success_rate, count(*) FILTER (detected < 50) = 0 AS robust FROM ph GROUP BY 1", _E6))
def _(spark, d):
    return po.worst_case(_phases(spark, d), 50).withColumns({c: F.round(c, 6) for c in ("mean_retained", "success_rate")})


@register("t01_high_recall_view", duck("SELECT t_a, t_b, row_number() OVER (ORDER BY recall DESC NULLS LAST, candidate_rate NULLS LAST, t_a, t_b) AS place FROM table1 WHERE recall >= 0.5", _TABLE))
def _(spark, d):
    return po.rank_policies(_table(spark, d), least_recall=0.5).select("t_a", "t_b", "place")


@register("t02_full_recall_ranking", duck("SELECT t_a, t_b, row_number() OVER (ORDER BY recall DESC NULLS LAST, candidate_rate NULLS LAST, t_a, t_b) AS place FROM table1 WHERE detected = n_intervals", _TABLE))
def _(spark, d):
    return po.rank_policies(_table(spark, d), full=True).select("t_a", "t_b", "place")


@register("t03_best_policy", duck("SELECT t_a, t_b, n_intervals - detected AS missed FROM table1 ORDER BY n_intervals - detected, candidate_rate, t_a, t_b LIMIT 1", _TABLE))
def _(spark, d):
    return po.best_policy(_table(spark, d)).select("t_a", "t_b", "missed")


@register("t10_highest_recall", duck("SELECT t_b, round(max(recall), 9) AS recall FROM table1 GROUP BY 1", _TABLE))
def _(spark, d):
    return _table(spark, d).groupBy("t_b").agg(F.round(F.max("recall"), 9).alias("recall"))


@register("a01_recall_breakdown", duck("SELECT CASE WHEN grouping(category, severity) = 1 THEN 'category' WHEN grouping(category, severity) = 2 THEN 'severity' ELSE 'all' END AS level, coalesce(category, severity) AS value, count(*) AS n, count(*) FILTER (coalesce(a_in >= 0.1, false)) AS n_detected, round(count(*) FILTER (coalesce(a_in >= 0.1, false)) / count(*), 9) AS recall FROM mx GROUP BY GROUPING SETS ((category), (severity), ())", _TABLE))
def _(spark, d):
    hits = po.interval_maxima(_shown(spark, d), standin(spark, d, "truth"), scores=("a", "b"), tol=HOUR, width=4 * HOUR)
    hits = hits.withColumn("detected", F.coalesce(F.col("a_in") >= 0.1, F.lit(False)))
    return po.recall_breakdown(hits).withColumn("recall", F.round("recall", 9))


@register("a02_candidate_rates", duck("SELECT media_id, count(*) AS n, count(*) FILTER (a >= 0.1) AS n_candidates, count(*) FILTER (a >= 0.1 AND inside) AS n_inside, round(count(*) FILTER (a >= 0.1) / count(*), 9) AS rate, round(count(*) FILTER (a >= 0.1 AND inside) / nullif(count(*) FILTER (a >= 0.1), 0), 9) AS precision FROM (SELECT s.*, EXISTS (SELECT 1 FROM truth t WHERE t.media_id = s.media_id AND s.ts_us BETWEEN t.start_us AND t.end_us) AS inside FROM samples s) GROUP BY 1"))
def _(spark, d):
    out = po.candidate_rates(_samples(spark, d), F.col("a") >= 0.1, standin(spark, d, "truth"), width=4 * HOUR)
    return out.withColumns({c: F.round(c, 9) for c in ("rate", "precision")})


_WORK = f"(SELECT media_id, duration_us, greatest(0, ts_us - {HOUR}) AS start_us, least(duration_us, ts_us + {HOUR}) AS end_us FROM samples WHERE a >= 0.1)"


@register("a03_workload", duck(f"SELECT media_id, count(*) AS n_windows, sum(l)::BIGINT AS total_us, round(avg(l), 3) AS mean_us, median(l) AS median_us, max(l) AS longest_us, round(sum(l) / max(du), 9) AS media_fraction, count(*) * 6 AS images FROM (SELECT media_id, end_us - start_us AS l, du FROM {merged(_WORK, 6 * HOUR, ', max(duration_us) AS du')}) GROUP BY 1"))
def _(spark, d):
    out = po.workload(_samples(spark, d).where("a >= 0.1"), context=HOUR, gap=6 * HOUR)
    return out.withColumns({"mean_us": F.round("mean_us", 3), "media_fraction": F.round("media_fraction", 9)})


_POP = "pop AS (SELECT *, unnest(list_filter(['all', CASE WHEN r THEN 'inside:red' END, CASE WHEN g THEN 'inside:green' END, CASE WHEN NOT i THEN 'outside' END], lambda x: x IS NOT NULL)) AS population FROM (SELECT s.media_id, s.sample_id, any_value(a)::DOUBLE AS a, coalesce(bool_or(category = 'red'), false) AS r, coalesce(bool_or(category = 'green'), false) AS g, count(t.media_id) > 0 AS i FROM samples s LEFT JOIN truth t ON t.media_id = s.media_id AND s.ts_us BETWEEN t.start_us AND t.end_us GROUP BY 1, 2))"


def _population(spark, d):
    return po.population_masks(_samples(spark, d), standin(spark, d, "truth"), ("red", "green"), width=4 * HOUR)


@register("a04_score_distribution", duck("SELECT population, 'a' AS score, count(*) AS n, min(a) AS least, round(quantile_cont(a, 0.5), 9) AS median, round(quantile_cont(a, 0.9), 9) AS p90, round(quantile_cont(a, 0.95), 9) AS p95, round(quantile_cont(a, 0.99), 9) AS p99, max(a) AS most FROM pop GROUP BY 1", _POP))
def _(spark, d):
    out = po.score_distribution(_population(spark, d), ["a"], ["population"])
    return out.withColumns({c: F.round(c, 9) for c in ("median", "p90", "p95", "p99")})


@register("a05_population_masks", duck("SELECT media_id, sample_id, population FROM pop", _POP))
def _(spark, d):
    return _population(spark, d).select("media_id", "sample_id", "population")


@register("a06_interval_peaks", duck("SELECT t.media_id, t.interval_id, max(a::DOUBLE) AS a_peak, arg_max(ts_us, (a, -ts_us)) AS a_peak_us, max(b::DOUBLE) AS b_peak, arg_max(ts_us, (b, -ts_us)) AS b_peak_us FROM truth t JOIN samples s ON s.media_id = t.media_id AND ts_us BETWEEN start_us AND end_us GROUP BY 1, 2"))
def _(spark, d):
    return po.interval_peaks(_samples(spark, d), standin(spark, d, "truth"), scores=("a", "b"), width=4 * HOUR)


@register("a22_overlap_pairs", duck("SELECT a.media_id, count(*) AS n FROM truth a JOIN truth b ON a.media_id = b.media_id AND a.interval_id < b.interval_id AND a.start_us <= b.end_us AND b.start_us <= a.end_us GROUP BY 1"))
def _(spark, d):
    from ..operators.timeline import range_join

    t = standin(spark, d, "truth").select("media_id", "interval_id", "start_us", "end_us")
    return range_join(t, t, width=4 * HOUR).where("interval_id < r_interval_id").groupBy("media_id").agg(F.count("*").alias("n"))


@register("u01_union_policies", duck("SELECT t_a, t_b, count(*) AS n FROM (SELECT DISTINCT media_id, sample_id, t_a, t_b FROM (SELECT media_id, sample_id, t_a, t_b FROM samples, grid WHERE a::DOUBLE >= t_a UNION ALL SELECT media_id, sample_id, t_a, t_b FROM samples, grid WHERE b::DOUBLE >= t_b)) GROUP BY 1, 2", _GRID_SQL))
def _(spark, d):
    return po.passing_counts(_samples(spark, d), _grid(spark), "a", "b").select("t_a", "t_b", F.col("passing").alias("n"))


@register("u02_union_samples", duck(f"SELECT media_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY media_id, (ts_us + 1) // {24 * HOUR} ORDER BY ts_us, sample_id) AS n FROM samples) WHERE n = 1 UNION SELECT media_id, sample_id FROM samples WHERE scene"))
def _(spark, d):
    from ..operators.sampling import sample_grid

    rows = _samples(spark, d)
    grid = sample_grid(rows, every=24 * HOUR, tie=("sample_id",)).select("media_id", "sample_id")
    return grid.unionByName(rows.where("scene").select("media_id", "sample_id")).distinct()


@register("t07_first_frame_at_or_after", duck(f"SELECT media_id, min(ts_us) FILTER (ts_us >= {30 * MINUTE}) AS ts_us FROM samples GROUP BY 1"))
def _(spark, d):
    from ..operators.verdicts import first_at_or_after

    return first_at_or_after(standin(spark, d, "samples"), 30 * MINUTE)
