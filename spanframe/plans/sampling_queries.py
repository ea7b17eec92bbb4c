"""Queries of timeline sampling and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching as mt
from ..operators import sampling as sm
from .registry import register
from .standins import HOUR, MINUTE, duck, merged, standin

_S = ("sample_id",)


@register("m01_plan_chunks", duck(f"SELECT media_id, duration_us, chunk, chunk * {72 * HOUR} AS core_start_us, least(duration_us, (chunk + 1) * {72 * HOUR}) AS core_end_us, greatest(0, chunk * {72 * HOUR} - {HOUR}) AS decode_start_us, least(duration_us, least(duration_us, (chunk + 1) * {72 * HOUR}) + {HOUR}) AS decode_end_us FROM (SELECT media_id, duration_us, unnest(range(greatest(1, ceil(duration_us / {72 * HOUR})::BIGINT))) AS chunk FROM media)"))
def _(spark, d):
    return sm.plan_chunks(standin(spark, d, "media"), core=72 * HOUR, overlap=2 * HOUR)


@register("m02_owning_chunk", duck(f"SELECT media_id, sample_id, CASE WHEN t BETWEEN 0 AND duration_us THEN least(t // {72 * HOUR}, greatest(1, ceil(duration_us / {72 * HOUR}))::BIGINT - 1) END AS chunk FROM (SELECT *, ts_us + (sample_id % 3) * 500000 AS t FROM samples)"))
def _(spark, d):
    rows = standin(spark, d, "samples").withColumn("t", F.col("ts_us") + F.col("sample_id") % 3 * 500_000)
    return sm.owning_chunk(rows, core=72 * HOUR, ts="t").select("media_id", "sample_id", "chunk")


@register("m03_sample_grid", duck(f"SELECT media_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY media_id, (ts_us + 1) // {24 * HOUR} ORDER BY ts_us, sample_id) AS n FROM samples) WHERE n = 1"))
def _(spark, d):
    return sm.sample_grid(standin(spark, d, "samples"), every=24 * HOUR, tie=_S).select("media_id", "sample_id")


_ORDERED = "o AS (SELECT media_id, ts_us, min(sample_id) AS sample_id, bool_or(scene) AS scene, row_number() OVER (PARTITION BY media_id ORDER BY ts_us) AS n FROM samples GROUP BY media_id, ts_us)"


@register("m04_dedupe_close", duck("SELECT media_id, sid AS sample_id, t AS ts_us, s AS scene FROM (SELECT *, lead(keep_n) OVER (PARTITION BY media_id ORDER BY n) AS nxt FROM r) WHERE nxt IS DISTINCT FROM keep_n", f"""{_ORDERED},
r AS (WITH RECURSIVE r AS (SELECT media_id, n, ts_us AS t, scene AS s, sample_id AS sid, 1 AS keep_n FROM o WHERE n = 1 UNION ALL
 SELECT o.media_id, o.n, CASE WHEN o.ts_us - r.t <= {6 * HOUR} AND NOT (o.scene AND NOT r.s) THEN r.t ELSE o.ts_us END, CASE WHEN o.ts_us - r.t <= {6 * HOUR} AND NOT (o.scene AND NOT r.s) THEN r.s ELSE o.scene END,
 CASE WHEN o.ts_us - r.t <= {6 * HOUR} AND NOT (o.scene AND NOT r.s) THEN r.sid ELSE o.sample_id END, CASE WHEN o.ts_us - r.t <= {6 * HOUR} THEN r.keep_n ELSE r.keep_n + 1 END FROM r JOIN o ON o.media_id = r.media_id AND o.n = r.n + 1) SELECT * FROM r)"""))
def _(spark, d):
    rows = standin(spark, d, "samples").groupBy("media_id", "ts_us").agg(F.min("sample_id").alias("sample_id"), F.bool_or("scene").alias("scene"))
    return sm.dedupe_close(rows, tol=6 * HOUR)


@register("m05_cadence_or_scene", duck(f"SELECT media_id, sample_id, list_filter([CASE WHEN p IS NULL THEN 'first' END, CASE WHEN p <> ts_us // {24 * HOUR} THEN 'cadence' END, CASE WHEN scene THEN 'scene' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT *, lag(ts_us // {24 * HOUR}) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) AS p FROM samples) WHERE p IS NULL OR p <> ts_us // {24 * HOUR} OR scene"), arrays=("reasons",))
def _(spark, d):
    return sm.cadence_or_scene(standin(spark, d, "samples"), cadence=24 * HOUR, scene=F.col("scene"), tie=_S).select("media_id", "sample_id", "reasons")


MIN_GAP_SQL = duck("SELECT media_id, t AS ts_us FROM r GROUP BY 1, 2", f"""{_ORDERED},
r AS (WITH RECURSIVE r AS (SELECT media_id, n, ts_us AS t FROM o WHERE n = 1 UNION ALL SELECT o.media_id, o.n, CASE WHEN o.ts_us - r.t >= {24 * HOUR} THEN o.ts_us ELSE r.t END FROM r JOIN o ON o.media_id = r.media_id AND o.n = r.n + 1) SELECT * FROM r)""")


@register("m06_sample_min_gap", MIN_GAP_SQL)
def _(spark, d):
    return sm.sample_min_gap(standin(spark, d, "samples"), gap=24 * HOUR)


@register("m06_sample_min_gap_chunked", MIN_GAP_SQL)
def _(spark, d):
    return sm.sample_min_gap(standin(spark, d, "samples"), gap=24 * HOUR, chunk=72 * HOUR)


@register("m07_sample_phase", duck(f"SELECT media_id, sample_id FROM (SELECT *, floor((ts_us - {5 * HOUR}) / {24 * HOUR}.0) AS slot, coalesce(lag(floor((ts_us - {5 * HOUR}) / {24 * HOUR}.0)) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id), -1) AS p FROM samples) WHERE slot >= 0 AND slot > p"))
def _(spark, d):
    return sm.sample_phase(standin(spark, d, "samples"), gap=24 * HOUR, phase=5 * HOUR, tie=_S).select("media_id", "sample_id")


@register("m08_phase_grid", duck("SELECT media_id, phase, count(*) AS n FROM (SELECT media_id, sample_id, phase, floor((ts_us - phase) / 10800000000.0) AS slot, coalesce(lag(floor((ts_us - phase) / 10800000000.0)) OVER (PARTITION BY media_id, phase ORDER BY ts_us, sample_id), -1) AS p FROM samples, (SELECT unnest([0, 2700000000, 3600000000, 5400000000, 7200000000, 8100000000]) AS phase)) WHERE slot >= 0 AND slot > p GROUP BY 1, 2"))
def _(spark, d):
    rows = standin(spark, d, "samples").select("*", F.explode(F.array(*[F.lit(p) for p in sm.phase_grid(3 * HOUR, HOUR)])).alias("phase"))
    w = Window.partitionBy("media_id", "phase").orderBy("ts_us", "sample_id")
    slot = F.floor((F.col("ts_us") - F.col("phase")) / (3 * HOUR))
    rows = rows.withColumn("slot", slot).withColumn("p", F.coalesce(F.lag("slot").over(w), F.lit(-1))).where("slot >= 0 and slot > p")
    return rows.groupBy("media_id", "phase").agg(F.count("*").alias("n"))


@register("m09_scene_mask", duck("SELECT media_id, sample_id FROM samples WHERE scene"))
def _(spark, d):
    rows = sm.cadence_or_scene(standin(spark, d, "samples"), cadence=24 * HOUR, scene=F.col("scene"), tie=_S)
    return sm.scene_mask(rows).select("media_id", "sample_id")


_LUMA = "list_transform(embedding, lambda x: 100 * abs(x)::DOUBLE)"


def _grid_sql(grid, x, y, w=4, width=8):
    """A block of w by w of a row-major list, as a list of its elements."""
    return "[" + ", ".join(f"{grid}[{(y + j) * width + x + i + 1}]" for j in range(w) for i in range(w)) + "]"


def _hash_sql(cells, width, height):
    """The difference hash of a row-major list: a bit for each neighbour to the right that is darker, the first the highest."""
    bits = [f"({cells}[{y * width + x + 1}] > {cells}[{y * width + x + 2}])::BIGINT" for y in range(height) for x in range(width - 1)]
    return " + ".join(f"({b} << {len(bits) - 1 - i})" for i, b in enumerate(bits))


_CORNERS = [(0, 0), (4, 0), (0, 4), (4, 4), (2, 2)]
_MEANS = ", ".join(f"round(list_sum({_grid_sql('l', x, y)}) / 16, 6)" for x, y in _CORNERS)
_HASHES = ", ".join(f"({_hash_sql(_grid_sql('l', x, y), 4, 4)})" for x, y in _CORNERS)


@register("m10_frame_features", f"SELECT vec_id, round(len(list_filter(l, lambda x: x < 16)) / 64, 9) AS black_fraction, round(list_sum(l) / 64, 6) AS mean_luma, {_hash_sql('l', 8, 8)} AS hash, [{_HASHES}] AS region_hashes, [round(list_sum(l) / 64, 6), round(list_sum(list_transform(l, lambda x: 100 - x)) / 64, 6)] AS mean_rgb, [{_MEANS}] AS red FROM (SELECT vec_id, {_LUMA} AS l FROM embeddings)", arrays=("region_hashes", "mean_rgb", "red"))
def _(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("luma", F.transform("embedding", lambda x: F.abs(x).cast("double") * 100)).withColumn("blue", F.transform("luma", lambda x: 100 - x))
    out = sm.frame_features(rows, "luma", 8, 8, rgb=("luma", "blue"))
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6))
    # a colour of every second mean: region_rgb holds a mean for each of the grids, region by region
    red = F.filter(F.transform("region_rgb", lambda x, i: F.when(i % 2 == 0, F.round(x, 6))), lambda x: x.isNotNull())
    return out.select("vec_id", F.round("black_fraction", 9).alias("black_fraction"), F.round("mean_luma", 6).alias("mean_luma"), "hash", "region_hashes", rounded("mean_rgb").alias("mean_rgb"), red.alias("red"))


#: Frames with whole and regional evidence; the regional hash of every 40th sample is another one.
_FRAMES = f"""f AS (SELECT media_id, sample_id, ts_us, ts_us // {72 * HOUR} AS chunk, scene, (sample_id % 10) / 9.0 >= 0.98 AS black, a * 100 AS luma, sample_id % 4 AS h, CASE WHEN sample_id % 40 = 1 THEN 255 ELSE sample_id % 4 END AS h2,
 row_number() OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) AS n FROM samples)"""
_ALIKE = "NOT x.black AND r.t IS NOT NULL AND bit_count(xor(x.h, r.h)) <= 3 AND bit_count(xor(x.h2, r.h2)) <= 3 AND abs(x.luma - r.luma) <= 12"
_WHAT = f"CASE WHEN x.black THEN 'black' WHEN {_ALIKE} AND x.chunk <> r.chunk AND x.ts_us - r.t <= {6 * HOUR} THEN 'near_duplicate' WHEN {_ALIKE} AND NOT x.scene AND x.ts_us - r.t < {48 * HOUR} THEN 'static_suppressed' ELSE 'representative' END"
_KEEP = lambda new, old: f"CASE {_WHAT} WHEN 'black' THEN NULL WHEN 'representative' THEN {new} ELSE {old} END"
_STATIC = f"""{_FRAMES}, r AS (WITH RECURSIVE r AS (SELECT media_id, n, sample_id, CASE WHEN black THEN 'black' ELSE 'representative' END AS what, NULL::BIGINT AS of_us, CASE WHEN NOT black THEN ts_us END AS t, CASE WHEN NOT black THEN chunk END AS chunk, CASE WHEN NOT black THEN luma END AS luma, CASE WHEN NOT black THEN h END AS h, CASE WHEN NOT black THEN h2 END AS h2 FROM f WHERE n = 1
 UNION ALL SELECT x.media_id, x.n, x.sample_id, {_WHAT}, CASE WHEN {_WHAT} IN ('near_duplicate', 'static_suppressed') THEN r.t END, {_KEEP('x.ts_us', 'r.t')}, {_KEEP('x.chunk', 'r.chunk')}, {_KEEP('x.luma', 'r.luma')}, {_KEEP('x.h', 'r.h')}, {_KEEP('x.h2', 'r.h2')} FROM r JOIN f x ON x.media_id = r.media_id AND x.n = r.n + 1) SELECT * FROM r)"""


STATIC_SQL = duck("SELECT media_id, sample_id, what AS disposition, of_us AS duplicate_of_us FROM r", _STATIC)


@register("m11_reduce_static", STATIC_SQL)
def _(spark, d):
    n = F.col("sample_id")
    rows = standin(spark, d, "samples").withColumns({"chunk": F.floor(F.col("ts_us") / (72 * HOUR)), "black_fraction": (n % 10) / 9.0, "mean_luma": F.col("a") * 100, "hash": (n % 4).cast("bigint")})
    rows = rows.withColumn("region_hashes", F.array(F.when(n % 40 == 1, 255).otherwise(F.col("hash")).cast("bigint")))
    return sm.reduce_static(rows, limit=48 * HOUR, cross=6 * HOUR)


_T = HOUR // 4
_REFINED = f"""mi AS (SELECT s.media_id, s.ts_us, s.scene, s.sample_id, w.interval_id AS win, (s.ts_us - w.start_us) // {HOUR // 2} AS tick FROM samples s JOIN truth w ON w.media_id = s.media_id AND s.ts_us BETWEEN w.start_us AND w.end_us),
mp AS (SELECT DISTINCT media_id, ts_us, scene, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY media_id, win, tick ORDER BY ts_us, sample_id) AS k FROM mi) WHERE k = 1 OR scene),
o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ts_us, NOT scene, sample_id) AS n FROM mp),
r AS (WITH RECURSIVE r AS (SELECT media_id, n, ts_us AS t, scene AS s, sample_id AS sid, 1 AS keep_n FROM o WHERE n = 1 UNION ALL
 SELECT o.media_id, o.n, CASE WHEN o.ts_us - r.t <= {_T} AND NOT (o.scene AND NOT r.s) THEN r.t ELSE o.ts_us END, CASE WHEN o.ts_us - r.t <= {_T} AND NOT (o.scene AND NOT r.s) THEN r.s ELSE o.scene END,
 CASE WHEN o.ts_us - r.t <= {_T} AND NOT (o.scene AND NOT r.s) THEN r.sid ELSE o.sample_id END, CASE WHEN o.ts_us - r.t <= {_T} THEN r.keep_n ELSE r.keep_n + 1 END FROM r JOIN o ON o.media_id = r.media_id AND o.n = r.n + 1) SELECT * FROM r)"""


@register("m12_refine_windows", duck("SELECT media_id, t AS ts_us, s AS scene, sid AS sample_id FROM (SELECT *, lead(keep_n) OVER (PARTITION BY media_id ORDER BY n) AS nxt FROM r) WHERE nxt IS DISTINCT FROM keep_n", _REFINED))
def _(spark, d):
    windows = standin(spark, d, "truth").withColumnRenamed("interval_id", "window_id")
    return sm.refine_windows(standin(spark, d, "samples").drop("duration_us"), windows, every=HOUR // 2, width=4 * HOUR, tol=HOUR // 4)


@register("m13_build_batches", duck("SELECT media_id, batch, frames, s AS start_us, greatest(e, s + 100000) AS end_us FROM (SELECT media_id, batch, list(ts_us ORDER BY ts_us) AS frames, greatest(0, min(ts_us) - 500000) AS s, least(max(duration_us), max(ts_us) + 500000) AS e FROM (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) - 1) // 8 AS batch FROM samples) GROUP BY 1, 2)"), arrays=("frames",))
def _(spark, d):
    return sm.build_batches(standin(spark, d, "samples"), size=8, tie=_S)


# recorded chunks, dispositions and totals of which some are wrong
_INV = f"""iv AS (SELECT media_id, sample_id, ts_us, duration_us, scene, least(ts_us // {72 * HOUR}, greatest(1, ceil(duration_us / {72 * HOUR}))::BIGINT - 1) + CASE WHEN sample_id % 97 = 0 THEN 1 ELSE 0 END AS chunk, CASE WHEN sample_id % 89 = 0 THEN 'odd' WHEN media_id % 13 = 5 THEN 'black' WHEN sample_id % 5 = 0 THEN 'static_suppressed' ELSE 'representative' END AS disposition, lag(ts_us) OVER w AS p, lag(ts_us) OVER (PARTITION BY media_id ORDER BY sample_id) AS back, first(ts_us) OVER w AS f, last(ts_us) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM samples WINDOW w AS (PARTITION BY media_id ORDER BY ts_us, sample_id)),
ip AS (SELECT *, CASE WHEN disposition = 'static_suppressed' THEN p END AS dup FROM iv),
im AS (SELECT media_id, max(greatest(coalesce(ts_us - p, ts_us), duration_us - l)) AS far, count(*) FILTER (disposition = 'representative') AS kept, count(*) AS n FROM ip GROUP BY 1)"""


@register("m14_check_invariants", duck(f"""SELECT name, detail = 0 AS passed, detail FROM (SELECT 'sorted' AS name, count(*) FILTER (ts_us < back) AS detail FROM ip UNION ALL SELECT 'in_range', 0 UNION ALL SELECT 'owned', count(*) FILTER (sample_id % 97 = 0) FROM ip UNION ALL SELECT 'longest_gap', count(*) FILTER (far > {48 * HOUR}) FROM im
 UNION ALL SELECT 'accounted', (SELECT count(*) FILTER (disposition = 'odd') FROM ip) + (SELECT count(*) FROM (SELECT media_id FROM im WHERE media_id % 7 = 0)) UNION ALL SELECT 'not_empty', count(*) FILTER (kept = 0) FROM im UNION ALL SELECT 'cores', count(*) FILTER (media_id % 11 = 0 AND duration_us > {72 * HOUR}) FROM media
 UNION ALL SELECT 'static', count(*) FROM ip WHERE disposition = 'static_suppressed' AND NOT coalesce(ts_us - dup < {12 * HOUR} AND NOT scene AND EXISTS (SELECT 1 FROM ip r WHERE r.media_id = ip.media_id AND r.ts_us = ip.dup AND r.disposition = 'representative'), false))""", _INV))
def _(spark, d):
    from ..operators.runs import disposition_stats

    n, w = F.col("sample_id"), Window.partitionBy("media_id").orderBy("ts_us", "sample_id")
    what = F.when(n % 89 == 0, "odd").when(F.col("media_id") % 13 == 5, "black").when(n % 5 == 0, "static_suppressed").otherwise("representative")
    rows = sm.owning_chunk(standin(spark, d, "samples"), core=72 * HOUR).withColumn("chunk", F.col("chunk") + F.when(n % 97 == 0, 1).otherwise(0)).withColumns({"disposition": what, "reasons": F.array(F.lit("temporal"))})
    rows = rows.withColumn("duplicate_of_us", F.when(F.col("disposition") == "static_suppressed", F.lag("ts_us").over(w)))
    chunks = sm.plan_chunks(standin(spark, d, "media"), core=72 * HOUR).withColumn("core_end_us", F.col("core_end_us") - F.when((F.col("media_id") % 11 == 0) & (F.col("chunk") == 0) & (F.col("duration_us") > 72 * HOUR), 1).otherwise(0))
    told = disposition_stats(rows, ["media_id"]).withColumn("n", F.col("n") + F.when(F.col("media_id") % 7 == 0, 1).otherwise(0))
    return sm.check_invariants(rows, core=72 * HOUR, gap=48 * HOUR, tie=_S, arrival="sample_id", chunks=chunks, recorded="chunk", static=12 * HOUR, statistics=told)


@register("w03_sample_gaps", duck("SELECT media_id, count(*) AS n, min(gap) AS least_us, max(gap) AS most_us, round(avg(gap), 3) AS mean_us, greatest(max(gap), min(ts_us), max(duration_us) - max(ts_us)) AS longest_us FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) AS gap FROM samples) GROUP BY 1"))
def _(spark, d):
    return sm.sample_gaps(standin(spark, d, "samples"), tie=_S).withColumn("mean_us", F.round("mean_us", 3))


def _scores(excluded: str) -> str:
    """CTEs of event matching by enumeration: excluded is a relation of ranges. pairs: the best matching of each island."""
    cut = lambda s, e, m: f"coalesce((SELECT sum(least(x.end_us, {e}) - greatest(x.start_us, {s})) FROM mx x WHERE x.media_id = {m} AND x.start_us < {e} AND {s} < x.end_us), 0)::BIGINT"
    seen = lambda c: f"NOT EXISTS (SELECT 1 FROM mx x WHERE x.media_id = v.media_id AND {c} BETWEEN x.start_us AND x.end_us)"
    side = lambda t: f"(SELECT media_id, interval_id, category, start_us, end_us, end_us - start_us - {cut('v.start_us', 'v.end_us', 'v.media_id')} AS whole, {seen('v.start_us')} AS ss, {seen('v.end_us')} AS es FROM {t} v WHERE end_us > start_us)"
    union = lambda t: f"(SELECT media_id, category, sum(end_us - start_us - {cut('v.start_us', 'v.end_us', 'v.media_id')})::BIGINT AS us FROM {merged(t, key='media_id, category')} v GROUP BY ALL)"
    lo, hi = "greatest(p.start_us, t.start_us)", "least(p.end_us, t.end_us)"
    return f"""mx AS (SELECT * FROM {merged(excluded)}), pv AS {side('predicted')}, tv AS {side('truth')},
ov AS (SELECT p.media_id, p.category, p.interval_id AS p, t.interval_id AS t, {hi} - {lo} - {cut(lo, hi, 'p.media_id')} AS common, p.whole + t.whole AS sides, least(p.start_us, t.start_us) AS lo, greatest(p.end_us, t.end_us) AS hi FROM pv p JOIN tv t ON p.media_id = t.media_id AND p.category = t.category AND p.start_us < t.end_us AND t.start_us < p.end_us),
ed AS (SELECT * FROM (SELECT media_id, category, p, t, common / (sides - common) AS iou, lo, hi, unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold FROM ov WHERE common > 0) WHERE iou >= threshold),
isl AS (SELECT *, row_number() OVER (PARTITION BY media_id, category, threshold, island ORDER BY p, t) AS k, count(*) OVER (PARTITION BY media_id, category, threshold, island) AS m FROM (SELECT *, sum(fresh) OVER (PARTITION BY media_id, category, threshold ORDER BY lo, hi, p, t) AS island FROM
 (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY media_id, category, threshold ORDER BY lo, hi, p, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM ed))),
tr AS (WITH RECURSIVE r AS (SELECT media_id, category, threshold, island, m, 0::BIGINT AS k, []::BIGINT[] AS ps, []::BIGINT[] AS ts, []::DOUBLE[] AS w FROM isl WHERE k = 1
 UNION ALL SELECT r.media_id, r.category, r.threshold, r.island, r.m, i.k, CASE WHEN take THEN list_append(ps, p) ELSE ps END, CASE WHEN take THEN list_append(ts, t) ELSE ts END, CASE WHEN take THEN list_append(w, iou) ELSE w END FROM r JOIN isl i ON (i.media_id, i.category, i.threshold, i.island, i.k) = (r.media_id, r.category, r.threshold, r.island, r.k + 1), (VALUES (true), (false)) x(take) WHERE NOT take OR NOT (list_contains(ps, p) OR list_contains(ts, t))) SELECT * FROM r WHERE k = m),
best AS (SELECT media_id, category, threshold, arg_max({{'p': ps, 't': ts, 'w': w}}, (len(w), coalesce(list_sum(w), 0))) AS x FROM tr GROUP BY media_id, category, threshold, island),
pairs AS (SELECT media_id, category, threshold, unnest(x.p) AS p, unnest(x.t) AS t, unnest(x.w) AS iou FROM best),
every AS (SELECT media_id, category, unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold FROM (SELECT media_id, category FROM pv UNION SELECT media_id, category FROM tv)),
np AS (SELECT media_id, category, count(*) FILTER (whole > 0) AS n, count(*) FILTER (whole <= 0) AS lost FROM pv GROUP BY ALL), nt AS (SELECT media_id, category, count(*) FILTER (whole > 0) AS n, count(*) FILTER (whole <= 0) AS lost FROM tv GROUP BY ALL),
mt AS (SELECT q.media_id, q.category, q.threshold, count(*) AS tp, count(*) FILTER (p.ss AND t.ss) AS start_n, coalesce(sum(p.start_us - t.start_us) FILTER (p.ss AND t.ss), 0)::BIGINT AS start_bias_us, coalesce(sum(abs(p.start_us - t.start_us)) FILTER (p.ss AND t.ss), 0)::BIGINT AS start_error_us,
 count(*) FILTER (p.es AND t.es) AS end_n, coalesce(sum(p.end_us - t.end_us) FILTER (p.es AND t.es), 0)::BIGINT AS end_bias_us, coalesce(sum(abs(p.end_us - t.end_us)) FILTER (p.es AND t.es), 0)::BIGINT AS end_error_us FROM pairs q JOIN pv p ON (p.media_id, p.interval_id) = (q.media_id, q.p) JOIN tv t ON (t.media_id, t.interval_id) = (q.media_id, q.t) GROUP BY ALL),
cv AS (SELECT p.media_id, p.category, sum({hi} - {lo} - {cut(lo, hi, 'p.media_id')})::BIGINT AS us FROM {merged('predicted', key='media_id, category')} p JOIN {merged('truth', key='media_id, category')} t ON p.media_id = t.media_id AND p.category = t.category AND p.start_us < t.end_us AND t.start_us < p.end_us GROUP BY ALL),
sc AS (SELECT e.*, coalesce(tp, 0) AS tp, coalesce(np.n, 0) - coalesce(tp, 0) AS fp, coalesce(nt.n, 0) - coalesce(tp, 0) AS fn, {", ".join(f"coalesce({c}, 0) AS {c}" for c in mt.COUNTS[3:])}, m.duration_us - {cut('0', 'm.duration_us', 'm.media_id')} AS evaluated_us,
 coalesce(tu.us, 0) AS target_us, coalesce(pu.us, 0) AS predicted_us, coalesce(cv.us, 0) AS covered_us, coalesce(np.lost, 0) AS ignored_predicted, coalesce(nt.lost, 0) AS ignored_true FROM every e JOIN media m ON m.media_id = e.media_id LEFT JOIN np ON (np.media_id, np.category) = (e.media_id, e.category) LEFT JOIN nt ON (nt.media_id, nt.category) = (e.media_id, e.category)
 LEFT JOIN mt ON (mt.media_id, mt.category, mt.threshold) = (e.media_id, e.category, e.threshold) LEFT JOIN {union('predicted')} pu ON (pu.media_id, pu.category) = (e.media_id, e.category) LEFT JOIN {union('truth')} tu ON (tu.media_id, tu.category) = (e.media_id, e.category) LEFT JOIN cv ON (cv.media_id, cv.category) = (e.media_id, e.category))"""


_HIDDEN = f"(SELECT media_id, greatest(0, ts_us - {20 * MINUTE}) AS start_us, least(duration_us, ts_us + {20 * MINUTE}) AS end_us FROM samples WHERE scene)"


def _evaluated(spark, d):
    samples = standin(spark, d, "samples").where("scene")
    hidden = samples.select("media_id", F.greatest(F.lit(0), F.col("ts_us") - 20 * MINUTE).alias("start_us"), F.least("duration_us", F.col("ts_us") + 20 * MINUTE).alias("end_us"))
    return mt.evaluate_media(standin(spark, d, "predicted"), standin(spark, d, "truth"), standin(spark, d, "media"), hidden, width=2 * HOUR)


@register("e08_match_events", duck("SELECT media_id, category, threshold, p, t, round(iou, 9) AS iou FROM pairs", _scores("(SELECT media_id, start_us, end_us FROM truth WHERE false)")))
def _(spark, d):
    out = mt.match_events(standin(spark, d, "predicted"), standin(spark, d, "truth"), thresholds=(0.25, 0.5, 0.75), width=2 * HOUR)
    return out.withColumn("iou", F.round("iou", 9))


@register("e09_evaluate_media", duck("SELECT * FROM sc", _scores(_HIDDEN)))
def _(spark, d):
    return _evaluated(spark, d)


_rate = lambda a, b, n: f"round({a} / nullif({b}, 0), 9) AS {n}"


@register("e10_event_score", duck(f"""SELECT *, target_us - covered_us AS missed_us, predicted_us - covered_us AS excess_us, {_rate('tp', '(tp + fp)', 'precision')}, {_rate('tp', '(tp + fn)', 'recall')}, {_rate('2 * tp', '(2 * tp + fp + fn)', 'f1')}, {_rate('covered_us', 'target_us', 'target_coverage')}, {_rate('covered_us', 'predicted_us', 'temporal_precision')},
 {_rate('start_bias_us', 'start_n', 'start_bias')}, {_rate('start_error_us', 'start_n', 'start_mae')}, {_rate('end_bias_us', 'end_n', 'end_bias')}, {_rate('end_error_us', 'end_n', 'end_mae')}, {_rate('fp * 60000000.0', 'evaluated_us', 'alerts_a_minute')} FROM agg""", _scores(_HIDDEN) + f""",
agg AS (SELECT threshold, count(*) AS n, {", ".join(f"sum({c})::BIGINT AS {c}" for c in (*mt.COUNTS, *mt.TIMES))}, round(sum(fp) FILTER (target_us = 0) * 60000000.0 / nullif(sum(evaluated_us) FILTER (target_us = 0), 0), 9) AS quiet_alerts_a_minute FROM sc GROUP BY 1)"""))
def _(spark, d):
    out = mt.aggregate_events(_evaluated(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "target_coverage", "temporal_precision", "start_bias", "start_mae", "end_bias", "end_mae", "alerts_a_minute", "quiet_alerts_a_minute")})


@register("a11_coverage", duck(f"""SELECT coalesce(p.media_id, t.media_id) AS media_id, coalesce(predicted_us, 0)::BIGINT AS predicted_us, coalesce(truth_us, 0)::BIGINT AS truth_us, coalesce(both_us, 0)::BIGINT AS both_us
 FROM (SELECT media_id, sum(end_us - start_us) AS predicted_us FROM {merged('predicted')} GROUP BY 1) p FULL JOIN (SELECT media_id, sum(end_us - start_us) AS truth_us FROM {merged('truth')} GROUP BY 1) t ON p.media_id = t.media_id
 LEFT JOIN (SELECT p.media_id, sum(least(p.end_us, t.end_us) - greatest(p.start_us, t.start_us)) AS both_us FROM {merged('predicted')} p JOIN {merged('truth')} t ON p.media_id = t.media_id AND p.start_us < t.end_us AND t.start_us < p.end_us GROUP BY 1) b ON b.media_id = coalesce(p.media_id, t.media_id)"""))
def _(spark, d):
    return mt.coverage(standin(spark, d, "predicted"), standin(spark, d, "truth"), width=4 * HOUR)
