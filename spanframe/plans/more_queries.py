"""Queries of alignment, reviews, streaming twins and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import runs as rn
from ..operators import stats as st
from ..operators import verdicts as vs
from ..sources import readers as rd
from .registry import register
from .standins import HOUR, duck, merged, standin


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# left rows in order of time, each with the nearest right row that is left: the list of those taken goes along
_NEAR = f"""l AS (SELECT media_id, sample_id, ts_us, row_number() OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) AS n FROM samples WHERE event_type = 'error'),
near AS (SELECT l.media_id, l.n, l.sample_id, list({{'d': abs(r.ts_us - l.ts_us), 't': r.ts_us, 'id': r.sample_id}} ORDER BY abs(r.ts_us - l.ts_us), r.ts_us, r.sample_id) FILTER (r.sample_id IS NOT NULL) AS c
  FROM l LEFT JOIN samples r ON r.media_id = l.media_id AND r.event_type = 'click' AND abs(r.ts_us - l.ts_us) <= {6 * HOUR} GROUP BY 1, 2, 3),
greedy AS (WITH RECURSIVE g AS (SELECT media_id, n, sample_id, c[1] AS p, [c[1].id] AS used FROM near WHERE n = 1
  UNION ALL SELECT x.media_id, x.n, x.sample_id, list_filter(x.c, lambda y: NOT coalesce(list_contains(g.used, y.id), false))[1], list_append(g.used, list_filter(x.c, lambda y: NOT coalesce(list_contains(g.used, y.id), false))[1].id) FROM g JOIN near x ON x.media_id = g.media_id AND x.n = g.n + 1) SELECT * FROM g)"""


@register("j02_align_nearest", duck("SELECT media_id, sample_id, p.id AS r_sample_id, p.d AS distance_us FROM greedy", _NEAR))
def _(spark, d):
    s = standin(spark, d, "samples")
    return al.align_nearest(s.where("event_type = 'error'"), s.where("event_type = 'click'"), tol=6 * HOUR)


# the frames of a media as one list in order: the positions are looked up in it, so no join is left to choose
@register("j14_frames_to_time", duck("SELECT o_orderkey, p[f + 1] AS start_us, p[f + 51] + 40000 AS end_us FROM (SELECT o_orderkey, o_custkey % 20 AS m, o_orderkey % 100 AS f FROM orders) LEFT JOIN (SELECT media_id, list(pts_us ORDER BY decode_pos) AS p FROM packets GROUP BY 1) ON media_id = m"))
def _(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("media_id"), (F.col("o_orderkey") % 100).alias("first_frame"), (F.col("o_orderkey") % 100 + 50).alias("last_frame"))
    frames = standin(spark, d, "packets").select("media_id", F.col("decode_pos").alias("frame"), "pts_us")
    return al.frames_to_time(rows, frames, frame_us=40_000).select("o_orderkey", "start_us", "end_us")


def _responses(spark, d):
    from ..operators.sampling import build_batches

    rows = build_batches(standin(spark, d, "samples"), size=8, tie=("sample_id",))
    return rows.withColumn("refs", F.array((F.col("batch") % 4).cast("int"), (F.col("batch") % 7 + 2).cast("int")))


_BATCH = "bt AS (SELECT media_id, batch, f, s AS start_us, greatest(e, s + 100000) AS end_us, [batch % 4, batch % 7 + 2] AS refs FROM (SELECT media_id, batch, list(ts_us ORDER BY ts_us) AS f, greatest(0, min(ts_us) - 500000) AS s, least(max(duration_us), max(ts_us) + 500000) AS e FROM (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) - 1) // 8 AS batch FROM samples) GROUP BY 1, 2)), rt AS (SELECT *, list_filter(list_transform(refs, lambda i: CASE WHEN i > 0 THEN f[i] END), lambda x: x IS NOT NULL) AS t FROM bt)"


@register("j15_local_refs_to_time", duck("SELECT media_id, batch, CASE WHEN len(t) = 0 THEN start_us ELSE greatest(start_us, list_min(t) - 500000) END AS from_us, CASE WHEN len(t) = 0 THEN end_us ELSE least(end_us, list_max(t) + 500000) END AS to_us FROM rt", _BATCH))
def _(spark, d):
    return al.local_refs_to_time(_responses(spark, d)).select("media_id", "batch", "from_us", "to_us")


@register("p18_response_rules", duck("SELECT media_id, batch, list_filter([CASE WHEN NOT (refs[1] BETWEEN 1 AND len(f) AND refs[2] BETWEEN 1 AND len(f)) THEN 'references' END, CASE WHEN refs[1] = refs[2] THEN 'unique' END], lambda x: x IS NOT NULL) AS problems FROM rt", _BATCH), arrays=("problems",))
def _(spark, d):
    rows = al.local_refs_to_time(_responses(spark, d))
    return rn.check_rules(rows, al.response_rules(rows)).select("media_id", "batch", "problems")


@register("j16_sidecar_policy", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'keep_embedded' WHEN x.p IS NOT NULL THEN 'add_external' ELSE 'none' END AS policy, x.p AS first_external FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) x ON x.o_custkey = c_custkey")
def _(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.col("o_orderpriority").alias("path"))
    return al.sidecar_policy(_t(spark, d, "customer").select("c_custkey"), o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'O'"), "c_custkey")


@register("j18_frame_targets", duck("SELECT media_id, interval_id, position, x.sample_id, s.ts_us FROM (SELECT media_id, interval_id, unnest([0, 1]) AS position, unnest([interval_id, interval_id + 1000000]) AS sample_id FROM truth) x LEFT JOIN (SELECT sample_id, ts_us FROM samples) s ON s.sample_id = x.sample_id"))
def _(spark, d):
    events = standin(spark, d, "truth").select("media_id", "interval_id", F.array("interval_id", F.col("interval_id") + 1_000_000).alias("frame_ids"))
    return al.frame_targets(events, standin(spark, d, "samples").select("sample_id", "ts_us"))[0]


@register("j19_transcript_source", duck("SELECT m.conv AS media_id, count(s.text) AS n, CASE WHEN count(s.text) FILTER (role = 'user') > 0 THEN 'subtitle' WHEN count(s.text) > 0 THEN 'speech' END AS source FROM (SELECT DISTINCT conv_id AS conv FROM conversations UNION SELECT page_id FROM pages) m LEFT JOIN segments s ON s.media_id = m.conv AND (role = 'user' OR (role = 'assistant' AND conv NOT IN (SELECT media_id FROM segments WHERE role = 'user'))) GROUP BY 1"))
def _(spark, d):
    s = standin(spark, d, "segments")
    media = s.select("media_id").union(_t(spark, d, "pages").select("page_id")).distinct()
    out = al.transcript_source(s.where("role = 'user'"), s.where("role = 'assistant'"), media)
    return out.groupBy("media_id").agg(F.count("text").alias("n"), F.max("source").alias("source"))


@register("j21_interval_events", duck(f"SELECT t.media_id, t.interval_id FROM truth t WHERE category = 'red' AND NOT EXISTS (SELECT 1 FROM predicted p WHERE p.media_id = t.media_id AND t.start_us - {HOUR} <= p.end_us AND p.start_us <= t.end_us + {HOUR})"))
def _(spark, d):
    from ..operators.timeline import range_join

    t = standin(spark, d, "truth").where("category = 'red'")
    hit = range_join(t, standin(spark, d, "predicted"), width=4 * HOUR, tol=HOUR).select("media_id", "interval_id").distinct()
    return t.select("media_id", "interval_id").join(hit, ["media_id", "interval_id"], "left_anti")


@register("j22_attribute_relation", "SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN 'west' WHEN 'de' THEN 'west' END, 'other') AS family FROM documents")
def _(spark, d):
    dim = spark.createDataFrame([("en", "west"), ("de", "west")], "lang string, family string")
    return al.lookup(_t(spark, d, "documents").select("doc_id", "lang"), dim, "lang", "family", "other").drop("lang")


_VERDICT = f"vd AS (SELECT t.media_id, t.interval_id, t.category, list_sort(list(DISTINCT p.interval_id) FILTER (p.interval_id IS NOT NULL)) AS events, coalesce(bool_or(p.confidence >= 0.05 AND t.start_us <= p.end_us AND p.start_us <= t.end_us), false) AS detected, coalesce(bool_or(p.confidence >= 0.05), false) AS detected_near, coalesce(bool_or(p.confidence >= 0.05 AND t.start_us <= p.end_us AND p.start_us <= t.end_us AND t.category = p.category), false) AS category_detected FROM truth t LEFT JOIN predicted p ON p.media_id = t.media_id AND t.start_us - {HOUR} <= p.end_us AND p.start_us <= t.end_us + {HOUR} GROUP BY 1, 2, 3)"


def _verdicts(spark, d):
    p = standin(spark, d, "predicted").withColumn("unsafe", F.col("confidence") >= 0.05)
    return al.interval_verdicts(p, standin(spark, d, "truth"), tol=HOUR, width=4 * HOUR)


@register("a15_silver_eval", duck("SELECT media_id, interval_id, coalesce(events, []) AS events, detected, detected_near, category_detected FROM vd", _VERDICT), arrays=("events",))
def _(spark, d):
    return _verdicts(spark, d).drop("category")


@register("a14_variant_summary", duck("SELECT category, count(*) AS n, round(avg(detected::INT), 9) AS detected_rate, round(avg(detected_near::INT), 9) AS detected_near_rate, round(avg(category_detected::INT), 9) AS category_detected_rate FROM vd GROUP BY 1", _VERDICT))
def _(spark, d):
    out = al.summarize_verdicts(_verdicts(spark, d), ["category"])
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith("_rate")})


@register("a21_alert_review", duck("SELECT group_id, count(*) AS n_alerts, count(*) FILTER (l = 'positive') AS n_true, count(*) FILTER (l IS NULL) AS n_open, CASE WHEN count(*) FILTER (l IS NULL) = 0 THEN round(count(*) FILTER (l = 'positive') / count(*), 9) END AS precision FROM (SELECT group_id, CASE WHEN item_id % 12 > 0 THEN CASE WHEN toxic = 1 THEN 'positive' ELSE 'negative' END END AS l FROM items WHERE n_chars > 1500) GROUP BY 1"))
def _(spark, d):
    rows = standin(spark, d, "items").where("n_chars > 1500").withColumn("label", F.when(F.col("item_id") % 12 > 0, F.when(F.col("toxic") == 1, "positive").otherwise("negative")))
    return al.alert_review(rows, ["group_id"]).withColumn("precision", F.round("precision", 9))


@register("a23_review_summary", duck("SELECT media_id, list_sort(list_filter(tr, lambda x: NOT list_contains(coalesce(sd, []), x))) AS missing, list_sort(list_filter(coalesce(sd, []), lambda x: NOT list_contains(tr, x))) AS extra, tr = coalesce(sd, []) AS exact FROM (SELECT media_id, list_sort(list(DISTINCT category)) AS tr FROM truth GROUP BY 1) t LEFT JOIN (SELECT media_id AS k, list_sort(list(DISTINCT category)) AS sd FROM predicted WHERE confidence >= 0.1 GROUP BY 1) p ON k = media_id"), arrays=("missing", "extra",))
def _(spark, d):
    t = standin(spark, d, "truth").groupBy("media_id").agg(F.collect_set("category").alias("true"))
    p = standin(spark, d, "predicted").where("confidence >= 0.1").groupBy("media_id").agg(F.collect_set("category").alias("said"))
    rows = t.join(p, "media_id", "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    return al.category_sets(rows, "said", "true").select("media_id", F.array_sort("missing").alias("missing"), F.array_sort("extra").alias("extra"), "exact")


@register("a24_technical_rollup", duck(f"SELECT band, count(*) AS n, max(score) AS score, sum(flagged)::BIGINT AS flagged_us FROM (SELECT s.media_id, CASE WHEN count(*) < 60 THEN 'small' ELSE 'large' END AS band, max(a)::DOUBLE AS score, coalesce(max(f), 0) AS flagged FROM samples s LEFT JOIN (SELECT media_id AS k, sum(end_us - start_us) AS f FROM {merged('truth')} GROUP BY 1) ON k = s.media_id GROUP BY 1) GROUP BY 1"))
def _(spark, d):
    from ..operators.intervals import total_duration

    flagged = total_duration(standin(spark, d, "truth"), overlap_aware=True)
    rows = standin(spark, d, "samples").groupBy("media_id").agg(F.count("*").alias("n"), F.max(F.col("a").cast("double")).alias("score")).join(flagged, "media_id", "left").na.fill(0, ["total_us"])
    return rows.groupBy(F.when(F.col("n") < 60, "small").otherwise("large").alias("band")).agg(F.count("*").alias("n"), F.max("score").alias("score"), F.sum("total_us").alias("flagged_us"))


@register("s08_media_probe", "SELECT page_id, (page_id * 1500000 + 250000)::BIGINT AS duration_us, 1280 AS width, round(30000 / 1001, 9) AS fps, true AS has_audio FROM pages")
def _(spark, d):
    text = F.concat(F.lit('{"format": {"duration": "'), (F.col("page_id") * F.lit(1.5).cast("decimal(10,2)") + F.lit(0.25).cast("decimal(10,2)")).cast("string"), F.lit('"}, "streams": [{"codec_type": "video", "width": 1280, "height": 688, "avg_frame_rate": "30000/1001"}, {"codec_type": "audio"}]}'))
    out = rd.media_probe(_t(spark, d, "pages").select("page_id", text.alias("probe")))
    return out.select("page_id", "duration_us", "width", F.round("fps", 9).alias("fps"), "has_audio")


@register("p22_validate_run_records", """SELECT doc_id AS item_id, doc_id AS attempt_id, coalesce(st, 'interrupted_unknown') AS status, list_filter([CASE WHEN quality IS NULL THEN 'unknown_item' END, CASE WHEN n > 1 THEN 'repeated_item' END, CASE WHEN source IS DISTINCT FROM 'web' THEN 'manifest_mismatch' END,
 CASE WHEN lang IS DISTINCT FROM lower(lang) THEN 'config_mismatch' END, CASE WHEN st NOT IN ('completed', 'failed') THEN 'bad_status' END, CASE WHEN st IS NOT NULL AND quality IS NOT NULL AND coalesce(abs(n_chars - 100) > 50, true) THEN 'duration_mismatch' END, CASE WHEN ml THEN 'mixed_configurations' END], lambda x: x IS NOT NULL) AS problems
 FROM (SELECT d.*, l.quality, CASE d.doc_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'started' END AS st, count(*) OVER (PARTITION BY d.doc_id) AS n, min(lang) OVER () <> max(lang) OVER () AS ml FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""", arrays=("problems",))
def _(spark, d):
    i = F.col("doc_id") % 4
    rows = _t(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("doc_id").alias("attempt_id"), F.col("source").alias("manifest_digest"), F.col("lang").alias("config_digest"), F.lower("lang").alias("effective_digest"),
        F.lit(None).cast("string").alias("environment_digest"), F.when(i == 0, "completed").when(i == 1, "failed").when(i == 2, "started").alias("status"), F.col("n_chars").cast("double").alias("seconds"),
    )
    manifest = _t(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.lit(100.0).alias("seconds"))
    return rn.validate_run_records(rows, manifest, digest="web", tol=50)


@register("b06_paired_delta", duck("SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, count(*) AS n_resamples FROM (SELECT r, sum(k2 - k) / sum(n) AS v FROM (SELECT r, i, ('0x' || substr(sha256('d|' || r || '|' || i), 1, 8))::BIGINT % (SELECT max(ng) FROM g) AS pick FROM (SELECT unnest(range(1, 101)) AS r) CROSS JOIN (SELECT unnest(range(1, (SELECT max(ng) FROM g) + 1)) AS i)) JOIN g ON gi = pick GROUP BY r)", "g AS (SELECT group_id, count(*) FILTER (toxic = 1) AS k, count(*) FILTER (quality = 0) AS k2, count(*) AS n, row_number() OVER (ORDER BY group_id) - 1 AS gi, count(*) OVER () AS ng FROM items GROUP BY group_id)"))
def _(spark, d):
    g = standin(spark, d, "items").groupBy("group_id").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count_if(F.col("quality") == 0).alias("k2"), F.count("*").alias("n"))
    delta = F.try_divide((F.col("k2") - F.col("k")).cast("double"), F.col("n").cast("double"))
    out = st.grouped_bootstrap(g, ["k", "k2", "n"], delta, resamples=100, seed="d")
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "n_resamples")


@register("b10_repro_compare", "SELECT vec_id, round(list_max(list_transform(range(64), lambda i: abs(embedding[i + 1]::DOUBLE - embedding[64 - i]::DOUBLE))), 7) AS max_difference, list_max(list_transform(range(64), lambda i: abs(embedding[i + 1]::DOUBLE - embedding[64 - i]::DOUBLE))) <= 0.3 AS within FROM embeddings")
def _(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    out = al.repro_compare(e, e.withColumn("embedding", F.reverse("embedding")), ["vec_id"], "embedding", tol=0.3)
    return out.withColumn("max_difference", F.round("max_difference", 7))


@register("t06_prompt_ranking", "SELECT label, row_number() OVER (ORDER BY q DESC NULLS LAST, label) AS place FROM (SELECT label, quantile_cont(embedding[1]::DOUBLE, 0.99) AS q FROM embeddings GROUP BY 1)")
def _(spark, d):
    return vs.prompt_ranking(_t(spark, d, "embeddings"), "label", F.col("embedding")[0].cast("double")).drop("q")
