"""Queries of unions of detectors, samplings and clustering settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning as pl
from ..operators import policy as po
from .registry import register
from .standins import HOUR, duck, standin

_BASELINES = [("A", 0.1, 0.97), ("B", 0.3, 0.99), ("C", 0.0, 0.9)]
_STRATEGIES = {"max": ("c1", "d1"), "mean": ("c2", "d2")}
_SEMANTIC = [(s, c, d) for s in _STRATEGIES for c in (0.7, 0.9, 0.99) for d in (0.8, 0.95)]
_GAPS = [12 * HOUR, 48 * HOUR]
_WINDOWS = [(c, g) for c in (HOUR, 4 * HOUR) for g in (0, 6 * HOUR)]
#: Merge gaps, contexts and longest events.
_CLUSTERING = [(g, c, m) for g in (HOUR, 2 * HOUR, 4 * HOUR, 8 * HOUR, 12 * HOUR, 18 * HOUR, 24 * HOUR, 36 * HOUR) for c in (0, HOUR, 2 * HOUR, 3 * HOUR, 5 * HOUR) for m in (15 * HOUR, 20 * HOUR, 30 * HOUR, 45 * HOUR, 60 * HOUR)]

_RATES = ("recall", "recall_near", "candidate_rate", "precision")
_POLICY = "baseline, strategy, t_a, t_b, t_c, t_d"
_none = [("", None, None)]
_rows = [(n, s, a, b, c, d) for n, a, b in _BASELINES + _none for s, c, d in _SEMANTIC] + [(n, "", a, b, None, None) for n, a, b in _BASELINES]
_value = lambda x: "NULL::DOUBLE" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"


def _union(configs: str, held: str) -> str:
    """CTEs of the union table: configs is a relation of names, held a condition on sample s and config g."""
    return f"""pol AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_value, r)) + ")" for r in _rows)}) p({_POLICY})),
s AS (SELECT media_id, sample_id, ts_us, duration_us, scene, a::DOUBLE AS va, ((sample_id * 271) % 1000 / 1000.0)::DOUBLE AS vb, b::DOUBLE AS c1, ((sample_id * 31) % 997 / 997.0)::DOUBLE AS d1, ((sample_id * 17) % 1000 / 1000.0)::DOUBLE AS c2, (a / 2)::DOUBLE AS d2 FROM samples),
cfg AS (SELECT config, {_POLICY} FROM {configs}, pol),
hit AS (SELECT s.*, cfg.* FROM s, cfg WHERE coalesce(va >= t_a, false) OR coalesce(vb >= t_b, false) OR (({held}) AND (coalesce(CASE strategy WHEN 'max' THEN c1 WHEN 'mean' THEN c2 END >= t_c, false) OR coalesce(CASE strategy WHEN 'max' THEN d1 WHEN 'mean' THEN d2 END >= t_d, false)))),
n1 AS (SELECT config, {_POLICY}, count(*) AS n_candidates, count(*) FILTER (EXISTS (SELECT 1 FROM truth t WHERE t.media_id = hit.media_id AND hit.ts_us BETWEEN t.start_us AND t.end_us)) AS n_inside FROM hit GROUP BY ALL),
n2 AS (SELECT config, {_POLICY}, count(DISTINCT (t.media_id, interval_id)) FILTER (ts_us BETWEEN start_us AND end_us) AS detected, count(DISTINCT (t.media_id, interval_id)) AS detected_near FROM hit h JOIN truth t ON t.media_id = h.media_id AND ts_us BETWEEN start_us - {HOUR} AND end_us + {HOUR} GROUP BY ALL),
n0 AS (SELECT config, (SELECT count(*) FROM truth) AS n_intervals, count(*) AS n_samples, count(*) FILTER ({held}) AS n_retained FROM s, {configs} g GROUP BY config),
u AS (SELECT cfg.*, n_intervals, n_samples, n_retained, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_inside, 0) AS n_inside, coalesce(detected, 0) AS detected, coalesce(detected_near, 0) AS detected_near FROM cfg JOIN n0 ON n0.config = cfg.config
 LEFT JOIN n1 ON (cfg.config, cfg.baseline, cfg.strategy) = (n1.config, n1.baseline, n1.strategy) AND cfg.t_c IS NOT DISTINCT FROM n1.t_c AND cfg.t_d IS NOT DISTINCT FROM n1.t_d
 LEFT JOIN n2 ON (cfg.config, cfg.baseline, cfg.strategy) = (n2.config, n2.baseline, n2.strategy) AND cfg.t_c IS NOT DISTINCT FROM n2.t_c AND cfg.t_d IS NOT DISTINCT FROM n2.t_d)"""


def _scored(spark, d):
    i = F.col("sample_id")
    return standin(spark, d, "samples").withColumns({"a": F.col("a").cast("double"), "b": (i * 271 % 1000) / 1000.0, "c1": F.col("b").cast("double"), "d1": (i * 31 % 997) / 997.0, "c2": (i * 17 % 1000) / 1000.0, "d2": (F.col("a") / 2).cast("double")})


def _policies(spark):
    return po.union_policies(spark.createDataFrame(_SEMANTIC, "strategy string, t_c double, t_d double"), _BASELINES)


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


_ALL = _union("(SELECT 'all' AS config)", "true")


@register("e03_evaluate_union", duck("SELECT *, round(detected / n_intervals, 9) AS recall, round(detected_near / n_intervals, 9) AS recall_near, round(n_candidates / n_samples, 9) AS candidate_rate, round(n_inside / nullif(n_candidates, 0), 9) AS precision FROM u", _ALL))
def _(spark, d):
    out = po.evaluate_union(_scored(spark, d), standin(spark, d, "truth"), _policies(spark), _STRATEGIES, tol=HOUR, width=4 * HOUR)
    return _rounded(out, _RATES)


_start = "greatest(0, ts_us - context)"
_last = "least(duration_us, before + context)"


@register("e03_union_workload", duck(f"""SELECT media_id, {_POLICY}, context, gap, count(*) FILTER (fresh) AS n_windows, sum(least(duration_us, ts_us + context) - CASE WHEN fresh THEN {_start} ELSE {_last} END)::BIGINT AS total_us,
 round(sum(least(duration_us, ts_us + context) - CASE WHEN fresh THEN {_start} ELSE {_last} END) / count(*) FILTER (fresh), 3) AS mean_us, round(sum(least(duration_us, ts_us + context) - CASE WHEN fresh THEN {_start} ELSE {_last} END) / max(duration_us), 9) AS media_fraction, count(*) FILTER (fresh) * 6 AS images
 FROM (SELECT *, before IS NULL OR {_start} > {_last} + gap AS fresh FROM (SELECT *, lag(ts_us) OVER (PARTITION BY media_id, {_POLICY} ORDER BY ts_us, sample_id) AS before FROM hit), (VALUES {", ".join(f"({c}::BIGINT, {g}::BIGINT)" for c, g in _WINDOWS)}) w(context, gap)) GROUP BY ALL""", _ALL))
def _(spark, d):
    out = po.union_workload(_scored(spark, d), _policies(spark), _STRATEGIES, _WINDOWS)
    return out.withColumns({"mean_us": F.round("mean_us", 3), "media_fraction": F.round("media_fraction", 9)})


_ARRAYS = f"""o AS (SELECT media_id, list(ts_us ORDER BY ts_us, sample_id) AS ts, list(sample_id ORDER BY ts_us, sample_id) AS ids FROM samples GROUP BY 1),
take AS (WITH RECURSIVE r AS (SELECT media_id, gap, 1 AS i, ts, ids FROM o, (SELECT unnest([{", ".join(f"{g}::BIGINT" for g in _GAPS)}]) AS gap)
 UNION ALL SELECT media_id, gap, j, ts, ids FROM (SELECT *, list_min(list_filter(range(i + 1, len(ts) + 1), lambda k: ts[k] - ts[i] >= gap)) AS j FROM r) WHERE j IS NOT NULL) SELECT media_id, gap, ids[i] AS sample_id FROM r),
held AS (SELECT media_id, sample_id, 'gap:' || gap AS config FROM take UNION SELECT media_id, sample_id, 'gap:' || gap || '+scene' FROM take UNION SELECT media_id, sample_id, 'gap:' || gap || '+scene' FROM samples, (SELECT unnest([{", ".join(f"{g}::BIGINT" for g in _GAPS)}]) AS gap) WHERE scene)"""
_SAMPLED = _ARRAYS + ",\n" + _union("(SELECT DISTINCT config FROM held)", "(media_id, sample_id, config) IN (SELECT (media_id, sample_id, config) FROM held)") + """,
e AS (SELECT config, max(n_retained) AS n_retained, max(n_samples) / max(n_retained) AS reduction, 100.0 * max(n_retained) / max(n_samples) AS seconds, count(*) FILTER (x) AS n_exact, min(CASE WHEN x THEN {'r': n_candidates / n_samples, 'b': baseline, 's': strategy, 'c': t_c, 'd': t_d} END) AS p FROM (SELECT *, detected = n_intervals AND strategy <> '' AND baseline <> '' AS x FROM u) GROUP BY 1)"""


def _summary(spark, d):
    rows = po.samplings(_scored(spark, d), _GAPS)
    table = po.evaluate_union(rows, standin(spark, d, "truth"), _policies(spark), _STRATEGIES, tol=HOUR, width=4 * HOUR, configs=po.sampling_names(_GAPS))
    return po.sampling_summary(table, full_seconds=100.0)


@register("e05_sampling_ablation", duck("SELECT config, n_retained, round(reduction, 9) AS reduction, round(seconds, 9) AS seconds, n_exact, round(p.r, 9) AS candidate_rate, p.b AS baseline, p.s AS strategy, p.c AS t_c, p.d AS t_d FROM e", _SAMPLED))
def _(spark, d):
    return _rounded(_summary(spark, d), ("reduction", "seconds", "candidate_rate"))


@register("e07_resolve_policy", duck(f"SELECT config, p.b AS baseline, v.t_a, v.t_b, p.s AS strategy, p.c AS t_c, p.d AS t_d, round(p.r, 9) AS candidate_rate FROM e JOIN (VALUES {', '.join('(' + ', '.join(map(_value, b)) + ')' for b in _BASELINES)}) v(baseline, t_a, t_b) ON v.baseline = p.b WHERE config = 'gap:{_GAPS[0]}+scene'", _SAMPLED))
def _(spark, d):
    baselines = spark.createDataFrame(_BASELINES, "baseline string, t_a double, t_b double")
    return _rounded(po.resolve_policy(_summary(spark, d), baselines, f"gap:{_GAPS[0]}+scene"), ("candidate_rate",))


_EVENTS = f"""grid AS (SELECT * FROM (VALUES {", ".join(f"({g}::BIGINT, {c}::BIGINT, {m}::BIGINT)" for g, c, m in _CLUSTERING)}) x(gap, context, longest)),
c AS (SELECT media_id, sample_id, ts_us, duration_us, a >= 0.1 AS by_a, b >= 0.6 AS by_b FROM samples WHERE a >= 0.1 OR b >= 0.6),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY gap, media_id ORDER BY ts_us, sample_id) AS island FROM (SELECT gap, c.*, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY gap, media_id ORDER BY ts_us, sample_id) > gap THEN 1 ELSE 0 END AS fresh FROM c, (SELECT DISTINCT gap FROM grid))),
l AS (SELECT gap, media_id, island, max(duration_us) AS du, list(ts_us ORDER BY ts_us, sample_id) AS t, list(by_a ORDER BY ts_us, sample_id) AS fa, list(by_b ORDER BY ts_us, sample_id) AS fb FROM g GROUP BY ALL),
parts AS (WITH RECURSIVE p AS (SELECT grid.gap, context, longest, media_id, du, t, fa, fb FROM l JOIN grid ON grid.gap = l.gap
 UNION ALL SELECT gap, context, longest, media_id, du, unnest([t[:k], t[k+1:]]), unnest([fa[:k], fa[k+1:]]), unnest([fb[:k], fb[k+1:]]) FROM (SELECT *, list_position(d, list_max(d)) AS k FROM
  (SELECT *, list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i]) AS d FROM p WHERE len(t) > 1 AND t[len(t)] - t[1] + 2 * context > longest)))
 SELECT * FROM p WHERE len(t) = 1 OR t[len(t)] - t[1] + 2 * context <= longest),
ev2 AS (SELECT *, greatest(0, t[1] - context) AS s, least(du, t[len(t)] + context) AS e, len(list_distinct(t)) AS times, len(t) AS n, list_bool_or(fa) AS ha, list_bool_or(fb) AS hb FROM parts),
ev3 AS (SELECT *, e - greatest(s, coalesce(lag(e) OVER (PARTITION BY gap, context, longest, media_id ORDER BY t[1]), s)) AS fresh FROM ev2),
t4 AS (SELECT gap, context, longest, media_id, sum(n)::BIGINT AS n_candidates, count(*) AS n_events, round(avg(e - s), 3) AS mean_us, median(e - s) AS median_us, round(quantile_cont(e - s, 0.9), 3) AS p90_us, max(e - s) AS longest_us, sum(e - s)::BIGINT AS total_us, count(*) FILTER (ha AND NOT hb) AS a_only, count(*) FILTER (hb AND NOT ha) AS b_only, count(*) FILTER (ha AND hb) AS both,
 sum(least(6, times))::BIGINT AS images, max(least(6, times)) AS most_images, count(*) FILTER (times >= 6) AS full_events, round(1 - count(*) / sum(n), 9) AS reduction, round(sum(fresh) / max(du), 9) AS media_fraction FROM ev3 GROUP BY ALL),
det AS (SELECT t.media_id, count(*) AS n_intervals, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE c.media_id = t.media_id AND c.ts_us BETWEEN t.start_us AND t.end_us)) AS detected, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE c.media_id = t.media_id AND c.ts_us BETWEEN t.start_us - {HOUR} AND t.end_us + {HOUR})) AS detected_near FROM truth t GROUP BY 1)"""


def _candidates(spark, d):
    return standin(spark, d, "samples").withColumns({"by_a": F.col("a") >= 0.1, "by_b": F.col("b") >= 0.6}).where("by_a or by_b")


@register("e04_evaluate_clustering", duck("SELECT * FROM t4", _EVENTS))
def _(spark, d):
    out = pl.evaluate_clustering(_candidates(spark, d), _CLUSTERING)
    return out.withColumns({"mean_us": F.round("mean_us", 3), "p90_us": F.round("p90_us", 3), "reduction": F.round("reduction", 9), "media_fraction": F.round("media_fraction", 9)})


@register("e04_detections", duck("SELECT *, round(detected / n_intervals, 9) AS recall, round(detected_near / n_intervals, 9) AS recall_near FROM det", _EVENTS))
def _(spark, d):
    return _rounded(pl.detections(_candidates(spark, d), standin(spark, d, "truth"), tol=HOUR, width=4 * HOUR), ("recall", "recall_near"))


@register("e04_best_clustering", duck("SELECT media_id, unnest(min({'n_events': n_events, 'images': images, 'total_us': total_us, 'longest_us': longest_us, 'gap': gap, 'context': context, 'longest': longest})) FROM t4 WHERE media_id IN (SELECT media_id FROM det WHERE detected = n_intervals) GROUP BY 1", _EVENTS))
def _(spark, d):
    rows = _candidates(spark, d)
    return pl.best_clustering(pl.evaluate_clustering(rows, _CLUSTERING), pl.detections(rows, standin(spark, d, "truth"), tol=HOUR, width=4 * HOUR))
