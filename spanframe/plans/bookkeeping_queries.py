"""Queries of validation, selection, catalogues and run records, over items with the traits that the rules are about."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as ct
from ..operators import runs as rn
from ..operators import selection as sl
from ..operators import validation as vd
from .registry import register
from .standins import duck, standin


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _problems(*rules):
    """DuckDB SQL of the names of broken rules; each is (name, condition that is broken)."""
    return f"list_filter([{', '.join(f'CASE WHEN coalesce({c}, false) THEN {chr(39)}{n}{chr(39)} END' for n, c in rules)}], lambda x: x IS NOT NULL)"


# --- scores

_SCORES = f"""sc AS (SELECT media_id, sample_id, CASE WHEN sample_id % 41 = 0 THEN ' ' ELSE sample_id::VARCHAR END AS ident, ts_us - CASE WHEN sample_id % 43 = 0 THEN 9000000000 ELSE 0 END AS ts_us, duration_us, sample_id % 10 / 10.0::DOUBLE AS p,
  CASE WHEN sample_id % 37 = 0 THEN NULL WHEN sample_id % 31 = 0 THEN 1.5 ELSE 0.9 - sample_id % 10 / 10.0 END::DOUBLE AS q, row_number() OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) AS place FROM samples),
sp AS (SELECT *, count(*) OVER (PARTITION BY media_id, ident) AS same_id, count(*) OVER (PARTITION BY media_id, ts_us) AS same_time, lag(ts_us) OVER (PARTITION BY media_id ORDER BY place) AS before FROM sc)"""
_SCORE_RULES = _problems(
    ("blank_id", "trim(ident) = ''"), ("finite", "q IS NULL"), ("range", "q IS NULL OR q < 0 OR q > 1"), ("sum", "q IS NULL OR abs(p + q + 0.1 - 1) > 0.00001 * greatest(1, p + q + 0.1)"),
    ("unique_id", "same_id > 1"), ("unique_time", "same_time > 1"), ("ordered", "ts_us < before"), ("in_media", "ts_us < 0 OR ts_us > duration_us"),
)


@register("p08_validate_scores", duck(f"SELECT media_id, place, {_SCORE_RULES} AS problems FROM sp", _SCORES), arrays=("problems",))
def _(spark, d):
    from pyspark.sql import Window

    n = F.col("sample_id")
    rows = standin(spark, d, "samples").withColumn("place", F.row_number().over(Window.partitionBy("media_id").orderBy("ts_us", "sample_id")))
    rows = rows.select("media_id", F.when(n % 41 == 0, " ").otherwise(n.cast("string")).alias("sample_id"), (F.col("ts_us") - F.when(n % 43 == 0, 9_000_000_000).otherwise(0)).alias("ts_us"), "duration_us", (n % 10 / 10.0).alias("sfw"), F.when(n % 37 == 0, None).when(n % 31 == 0, 1.5).otherwise(0.9 - n % 10 / 10.0).alias("nsfw"), F.lit(0.1).alias("nsfl"), "place")
    return vd.validate_scores(rows, ("sfw", "nsfw", "nsfl"), order="place").select("media_id", "place", "problems")


# --- manifests

# every trait of an item comes from its number, so that each rule is broken by some items and kept by others
_ITEM = """mi AS (SELECT item_id AS n, CASE WHEN item_id % 31 = 0 THEN 'twin' ELSE item_id::VARCHAR END AS item_id, group_id, CASE WHEN item_id % 29 = 0 THEN 'tuning' ELSE 'test' END AS split, CASE WHEN item_id % 23 = 0 THEN 'dup' WHEN item_id % 3 > 0 THEN md5(item_id::VARCHAR) END AS sha256,
  CASE WHEN item_id % 19 > 0 THEN n_chars * 1000 END AS duration_us, CASE WHEN toxic = 1 THEN 'positive' WHEN item_id % 5 = 0 THEN 'missing' WHEN item_id % 5 = 1 THEN 'uncertain' ELSE 'negative' END AS video_label,
  CASE WHEN item_id % 37 = 0 THEN 'complete' WHEN toxic = 0 AND item_id % 5 = 0 THEN 'unreviewed' WHEN item_id % 11 = 0 THEN 'unreviewed' ELSE 'complete' END AS review_basis,
  CASE item_id % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' ELSE 'unknown' END AS s1, CASE WHEN item_id % 4 = 0 THEN 'unknown' ELSE 'absent' END AS s2, CASE WHEN item_id % 13 = 0 THEN NULL WHEN item_id % 17 = 0 THEN 'odd' WHEN quality = 1 THEN 'absent' ELSE 'unknown' END AS s3,
  item_id % 10 = 0 AS excluded, CASE WHEN item_id % 20 = 0 OR item_id % 14 = 1 THEN 'x' ELSE ' ' END AS exclusion_reason, item_id % 2 = 1 AS timed, item_id % 7 < 5 AS exhaustive, CASE item_id % 4 WHEN 1 THEN ['nudity'] WHEN 3 THEN ['nudity', 'nudity'] ELSE [] END AS listed, item_id % 6 AS k FROM items),
mt AS (SELECT *, CASE WHEN NOT timed THEN [] WHEN k = 1 THEN [['a', '0', '500000', 'nudity']] WHEN k = 3 THEN [['a', '0', '900000000', 'sexual_activity'], ['a', '5', '7', 'nudity']] ELSE [] END AS ev, CASE WHEN timed AND k = 5 THEN [['h', '9', '9']] ELSE [] END AS hid FROM mi)"""
_ENDS = "(len(list_filter(ev, lambda e: e[3]::BIGINT > duration_us)) > 0 OR len(list_filter(hid, lambda e: e[3]::BIGINT > duration_us)) > 0)"
_STATE = "CASE c WHEN 'nudity' THEN s1 WHEN 'sexual_activity' THEN s2 END"
_MANIFEST_RULES = _problems(
    ("categories", "s3 IS NULL OR s3 = 'odd'"), ("basis", "(video_label = 'missing') <> (review_basis = 'unreviewed')"), ("negative_present", "video_label = 'negative' AND s1 = 'present'"),
    ("positive_absent", "video_label = 'positive' AND s1 = 'absent' AND s2 = 'absent' AND coalesce(s3, 'absent') = 'absent'"), ("exclusion_reason", "excluded <> (trim(exclusion_reason) <> '')"), ("temporal_duration", "timed AND duration_us IS NULL"),
    ("temporal_end", f"timed AND duration_us IS NOT NULL AND {_ENDS}"), ("exhaustive_unknown", "timed AND len(listed) > 0 AND s1 = 'unknown'"),
    ("event_absent", "(k = 1 AND timed AND s1 = 'absent') OR (k = 3 AND timed AND (s2 = 'absent' OR s1 = 'absent'))"), ("negative_events", "timed AND exhaustive AND video_label = 'negative' AND len(ev) > 0"),
    ("positive_without_events", "timed AND exhaustive AND video_label = 'positive' AND len(ev) = 0"), ("exhaustive_unique", "timed AND len(listed) = 2"), ("exhaustive_binary", "timed AND len(listed) > 0 AND NOT exhaustive"),
    ("unique_events", "timed AND k = 3"), ("unique_exclusions", "false"), ("reversed", "timed AND k = 5"), ("unique_id", "count(*) OVER (PARTITION BY item_id) > 1"), ("unique_hash", "sha256 IS NOT NULL AND count(*) OVER (PARTITION BY sha256) > 1"),
    ("one_split", "min(split) OVER (PARTITION BY group_id) <> max(split) OVER (PARTITION BY group_id)"), ("technical_positive", "video_label = 'positive' AND NOT excluded"),
)


def _manifest(spark, d):
    n = F.col("n")
    i = standin(spark, d, "items").withColumnRenamed("item_id", "n")
    event = lambda ident, start, end, *cats: F.struct(F.lit(ident).alias("event_id"), F.lit(start).cast("bigint").alias("start_us"), F.lit(end).cast("bigint").alias("end_us"), F.array(*map(F.lit, cats)).alias("categories"))
    none = F.array().cast("array<struct<event_id:string,start_us:bigint,end_us:bigint,categories:array<string>>>")
    events = F.when(n % 6 == 1, F.array(event("a", 0, 500_000, "nudity"))).when(n % 6 == 3, F.array(event("a", 0, 900_000_000, "sexual_activity"), event("a", 5, 7, "nudity"))).otherwise(none)
    hidden = F.when(n % 6 == 5, F.array(F.struct(F.lit("h").alias("exclusion_id"), F.lit(9).cast("bigint").alias("start_us"), F.lit(9).cast("bigint").alias("end_us"))))
    listed = F.when(n % 4 == 1, F.array(F.lit("nudity"))).when(n % 4 == 3, F.array(F.lit("nudity"), F.lit("nudity"))).otherwise(F.array().cast("array<string>"))
    clean = F.col("toxic") == 0
    label = F.when(~clean, "positive").when(n % 5 == 0, "missing").when(n % 5 == 1, "uncertain").otherwise("negative")
    third = F.when(n % 17 == 0, "odd").when(F.col("quality") == 1, "absent").otherwise("unknown")
    two = (F.lit("nudity"), F.when(n % 3 == 0, "present").when(n % 3 == 1, "absent").otherwise("unknown"), F.lit("sexual_activity"), F.when(n % 4 == 0, "unknown").otherwise("absent"))
    return i.select(
        "n", F.when(n % 31 == 0, "twin").otherwise(n.cast("string")).alias("item_id"), "group_id", F.when(n % 29 == 0, "tuning").otherwise("test").alias("split"), F.when(n % 23 == 0, "dup").when(n % 3 > 0, F.md5(n.cast("string"))).alias("sha256"),
        F.when(n % 19 > 0, F.col("n_chars") * 1000).alias("duration_us"), label.alias("video_label"), F.when(n % 37 == 0, "complete").when((clean & (n % 5 == 0)) | (n % 11 == 0), "unreviewed").otherwise("complete").alias("review_basis"),
        F.when(n % 13 == 0, F.create_map(*two)).otherwise(F.create_map(*two, F.lit("sexual_context"), third)).alias("category_labels"), (n % 10 == 0).alias("excluded"), F.when((n % 20 == 0) | (n % 14 == 1), "x").otherwise(" ").alias("exclusion_reason"),
        F.when(n % 2 == 1, F.struct((n % 7 < 5).alias("binary_exhaustive"), listed.alias("exhaustive_categories"), events.alias("events"), hidden.alias("excluded_intervals"))).alias("temporal"),
        F.create_map(F.lit("flag"), F.when(n % 15 == 2, "true").otherwise("false")).alias("provenance"),
    )


@register("p10_validate_manifest", duck(f"SELECT n, {_MANIFEST_RULES} AS problems FROM mt", _ITEM), arrays=("problems",))
def _(spark, d):
    return vd.validate_manifest(_manifest(spark, d), track="technical").select("n", "problems")


@register("p10_split_groups", duck("SELECT group_id, count(DISTINCT quality) AS n_splits FROM items GROUP BY 1 HAVING count(DISTINCT quality) > 1"))
def _(spark, d):
    return rn.split_groups(standin(spark, d, "items"), "group_id", "quality")


@register("p07_evaluable", duck("SELECT item_id, group_id FROM mt WHERE split = 'test' AND NOT excluded", _ITEM))
def _(spark, d):
    return vd.evaluable(_manifest(spark, d)).select("item_id", "group_id")


_RESULT = f"""{_ITEM}, rs AS (SELECT o_orderkey AS k, (o_orderkey % 5000)::VARCHAR AS item_id, CASE o_custkey % 3 WHEN 0 THEN 'A1' ELSE 'A2' END AS config, CASE o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'odd' ELSE 'completed' END AS status,
  CASE WHEN o_orderkey % 9 = 0 THEN 'old' ELSE 'now' END AS digest, o_orderkey % 11 > 0 AS has, CASE WHEN o_orderkey % 4 = 0 THEN md5((o_orderkey % 5000)::VARCHAR) ELSE 'other' END AS own, CASE WHEN o_orderkey % 5 > 0 THEN md5((o_orderkey % 5000)::VARCHAR) END AS source, CASE WHEN o_orderkey % 6 > 0 THEN true END AS verified, o_orderkey % 8 < 3 AS said, o_orderkey % 16 = 1 AS back FROM orders),
known AS (SELECT item_id AS id, min(sha256) AS sha FROM mt WHERE item_id <> 'twin' GROUP BY 1)"""
_RESULT_RULES = _problems(
    ("unique", "count(*) OVER (PARTITION BY item_id, config) > 1"), ("status", "status = 'odd'"), ("identity", "status = 'completed' AND NOT has"), ("suggestions", "status NOT IN ('completed', 'partial') AND said"),
    ("unverified", "config = 'A1' AND has AND (source IS NULL OR verified IS NULL)"), ("reversed", "said AND back"), ("manifest", "digest <> 'now'"), ("unknown_item", "id IS NULL"),
    ("hash", "sha IS NOT NULL AND has AND (CASE WHEN config = 'A1' THEN source ELSE own END) IS DISTINCT FROM sha"),
)


@register("p11_validate_results", duck(f"SELECT k, {_RESULT_RULES} AS problems FROM rs LEFT JOIN known ON id = item_id", _RESULT), arrays=("problems",))
def _(spark, d):
    k = F.col("o_orderkey")
    sha = F.md5((k % 5000).cast("string"))
    given = F.when(k % 11 > 0, F.struct(F.when(k % 4 == 0, sha).otherwise("other").alias("sha256"), F.when(k % 5 > 0, sha).alias("derived_from_sha256"), F.when(k % 6 > 0, True).alias("verified")))
    said = F.when(k % 8 < 3, F.array(F.struct(F.lit(5).cast("bigint").alias("start_us"), F.when(k % 16 == 1, 5).otherwise(9).cast("bigint").alias("end_us"))))
    rows = _t(spark, d, "orders").select(k.alias("k"), (k % 5000).cast("string").alias("item_id"), F.when(F.col("o_custkey") % 3 == 0, "A1").otherwise("A2").alias("config"), F.when(k % 7 == 0, "failed").when(k % 7 == 1, "partial").when(k % 7 == 2, "odd").otherwise("completed").alias("status"), F.when(k % 9 == 0, "old").otherwise("now").alias("manifest_digest"), given.alias("input"), said.alias("suggestions"))
    return vd.validate_results(rows, _manifest(spark, d).where("item_id <> 'twin'"), digest="now").select("k", "problems")


@register("p11_repeated_results", duck("SELECT item_id, config, count(*) AS n FROM attempts GROUP BY 1, 2 HAVING count(*) > 1"))
def _(spark, d):
    return rn.duplicates(standin(spark, d, "attempts"), ["item_id", "config"])


_REVIEW = """rv AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'uncertain' WHEN 3 THEN ' excluded ' WHEN 4 THEN 'positive' ELSE 'maybe' END AS label, CASE item_id % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' WHEN 2 THEN 'uncertain' ELSE 'absent' END AS s1,
  CASE WHEN item_id % 25 = 0 THEN '?' ELSE 'absent' END AS s2, CASE item_id % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'half' ELSE 'Yes' END AS watched, CASE item_id % 9 WHEN 0 THEN 'age_uncertain' WHEN 1 THEN 'odd' ELSE '' END AS esc, CASE WHEN item_id % 8 = 0 THEN 'why' END AS why,
  CASE item_id % 7 WHEN 0 THEN '0.5-2:nudity; 3 - 4.25:nudity' WHEN 1 THEN '1-2:sexual_activity' WHEN 2 THEN '9-3:nudity' WHEN 3 THEN 'x' WHEN 4 THEN '80-99:nudity' ELSE ' ' END AS ev, item_id % 7 AS e FROM items)"""
_L = "trim(label)"
_REVIEW_PROBLEMS = f"""CASE WHEN {_L} = 'maybe' THEN ['label'] WHEN {_L} = 'excluded' THEN {_problems(("escalation", "esc = 'odd'"), ("exclusion_reason", "why IS NULL AND esc = ''"))} ELSE list_concat({_problems(("escalation", "esc = 'odd'"))}, CASE WHEN s2 = '?' THEN ['states'] ELSE list_concat(
 {_problems(("watched", "watched = 'half'"), ("positive_present", f"{_L} = 'positive' AND s1 <> 'present'"), ("present_positive", f"{_L} <> 'positive' AND s1 = 'present'"), ("negative_absent", f"{_L} = 'negative' AND (s1 = 'uncertain' OR watched <> 'Yes')"), ("uncertain", f"{_L} = 'uncertain' AND s1 <> 'uncertain' AND watched = 'Yes'"), ("events", "e IN (2, 3, 4)"))},
 CASE WHEN e IN (2, 3, 4) THEN [] ELSE {_problems(("event_absent", "(e = 0 AND s1 = 'absent') OR e = 1"), ("negative_events", f"{_L} = 'negative' AND e < 2"))} END) END) END"""


@register("p12_validate_reviews", duck(f"SELECT item_id, {_REVIEW_PROBLEMS} AS problems FROM rv", _REVIEW), arrays=("problems",))
def _(spark, d):
    n = F.col("item_id")
    pick = lambda m, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % m + 1).cast("int"))
    rows = standin(spark, d, "items").select(
        "item_id", pick(6, "positive", "negative", "uncertain", " excluded ", "positive", "maybe").alias("video_label"), pick(4, "present", "absent", "uncertain", "absent").alias("nudity"), F.when(n % 25 == 0, "?").otherwise("absent").alias("sexual_activity"), F.lit("absent").alias("sexual_context"),
        pick(5, "no", "half", "Yes", "Yes", "Yes").alias("watched_in_full"), pick(9, "age_uncertain", "odd", *[""] * 7).alias("escalation"), F.lit("").alias("nudity_context"), F.when(n % 8 == 0, "why").alias("exclusion_reason"), pick(7, "0.5-2:nudity; 3 - 4.25:nudity", "1-2:sexual_activity", "9-3:nudity", "x", "80-99:nudity", " ", " ").alias("events"), F.lit(60.0).alias("duration_s"),
    )
    return vd.validate_reviews(rows, escalations=("", "age_uncertain")).select("item_id", "problems")


@register("p14_apply_subset", duck("SELECT item_id, split, excluded OR (split = 'test' AND n % 15 = 2) AS excluded, CASE WHEN split = 'test' AND n % 15 = 2 AND NOT excluded THEN 'subset: flagged' ELSE exclusion_reason END AS exclusion_reason FROM mt WHERE item_id <> 'twin'", _ITEM))
def _(spark, d):
    m = _manifest(spark, d).where("item_id <> 'twin'")
    spec = m.where("split = 'test' and n % 15 = 2").select("item_id")
    return vd.apply_subset(m, spec, subset_id="s", reason="flagged", flag="flag")[0].select("item_id", "split", "excluded", "exclusion_reason")


@register("p14_subset_record", duck("""SELECT 's' AS subset_id, 'groups' AS reason, count(*) FILTER (NOT excluded) AS base_evaluable, count(*) FILTER (NOT excluded AND NOT o) AS remaining_evaluable, count(*) FILTER (o) AS n_excluded, count(*) FILTER (o AND excluded) AS already_excluded,
 count(DISTINCT g) FILTER (NOT excluded) AS base_groups, count(DISTINCT g) FILTER (NOT excluded AND NOT o) AS remaining_groups, count(DISTINCT g) FILTER (o) AS excluded_groups, 0::BIGINT AS shared_groups FROM (SELECT *, g IN (SELECT 'g' || n % 40 FROM mt WHERE split = 'test' AND n % 15 = 2 AND n % 4 = 1 AND item_id <> 'twin') AS o FROM (SELECT *, 'g' || n % 40 AS g FROM mt) WHERE split = 'test' AND item_id <> 'twin')""", _ITEM))
def _(spark, d):
    flag = F.create_map(F.lit("flag"), F.when((F.col("n") % 15 == 2) & (F.col("n") % 4 == 1), "true").otherwise("no"))
    m = _manifest(spark, d).where("item_id <> 'twin'").withColumns({"group_id": F.concat(F.lit("g"), (F.col("n") % 40).cast("string")), "provenance": flag})
    hit = m.where("split = 'test' and provenance['flag'] = 'true'").select("group_id").distinct()
    spec = m.where("split = 'test'").join(hit, "group_id", "left_semi").select("item_id")
    return vd.apply_subset(m, spec, subset_id="s", reason="groups", flag="flag", scope="subject")[1]


@register("p15_apply_reference_labels", duck("SELECT item_id, CASE WHEN split = 'test' AND NOT excluded THEN CASE WHEN n % 2 = 0 THEN 'positive' ELSE 'negative' END ELSE video_label END AS video_label, CASE WHEN split = 'test' AND NOT excluded THEN 'complete' ELSE review_basis END AS review_basis FROM mt WHERE item_id <> 'twin'", _ITEM))
def _(spark, d):
    m = _manifest(spark, d).where("item_id <> 'twin'")
    labels = vd.evaluable(m).select("item_id", "sha256", F.when(F.col("n") % 2 == 0, "positive").otherwise("negative").alias("video_label"), F.lit("complete").alias("review_basis"))
    return vd.apply_reference_labels(m, labels, ["video_label", "review_basis"])[0].select("item_id", "video_label", "review_basis")


@register("p15_label_cover", duck("SELECT coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN a.item_id IS NULL THEN 'label only' WHEN b.item_id IS NULL THEN 'unlabelled' WHEN b.n % 8 = 0 THEN 'repeated' WHEN b.n % 12 = 2 THEN 'other file' ELSE 'both' END AS cover FROM (SELECT * FROM mt WHERE split = 'test' AND NOT excluded AND item_id <> 'twin') a FULL JOIN (SELECT * FROM mt WHERE item_id <> 'twin' AND n % 6 <> 1) b ON a.item_id = b.item_id", _ITEM))
def _(spark, d):
    m = _manifest(spark, d).where("item_id <> 'twin'")
    labels = m.where("n % 6 <> 1").select("item_id", F.when(F.col("n") % 12 == 2, "elsewhere").otherwise(F.col("sha256")).alias("sha256"), "video_label", "n")
    return vd.apply_reference_labels(m, labels.union(labels.where("n % 8 = 0")), ["video_label"])[1]


@register("p16_select_members", duck("SELECT item_id FROM items WHERE group_id IN (SELECT group_id FROM items GROUP BY 1 HAVING max(toxic + 1) = 2)"))
def _(spark, d):
    i = standin(spark, d, "items")
    return sl.select_members(i.select("item_id", "group_id"), i.select("group_id", (F.col("toxic") + 1).alias("level")), "level", ident="group_id").select("item_id")


_PROBE = """pb AS (SELECT page_id, length(html) AS n, url || CASE page_id % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MKV' WHEN 2 THEN '.avi' ELSE '.mp4' END AS path, CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 0 ELSE length(html) END AS len, page_id % 17 > 0 AS ok, CASE page_id % 7 WHEN 0 THEN 'mkv' WHEN 1 THEN 'ogg' ELSE CASE WHEN page_id % 5 = 1 THEN 'mkv' ELSE 'mp4' END END AS f,
  CASE WHEN page_id % 6 = 0 THEN 0 ELSE 1 END AS v, CASE WHEN page_id % 12 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN page_id % 18 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN page_id % 19 = 0 THEN '' ELSE 'h264' END AS codec, page_id % 23 AS w, CASE WHEN page_id % 21 = 0 THEN 0 ELSE 9 END AS head, CASE WHEN page_id % 10 = 3 THEN length(html) / 100.0 - 5 ELSE length(html) / 100.0 END AS tail FROM pages)"""


@register("p17_media_quality", duck("""SELECT page_id, split_part(x, '/', 1) AS category, split_part(x, '/', 2) AS code FROM (SELECT page_id, CASE WHEN len IS NULL THEN 'missing_file/media.missing_file' WHEN page_id % 5 = 2 THEN 'unsupported_format/media.unsupported_extension' WHEN len = 0 THEN 'corrupted_media/media.empty' WHEN NOT ok THEN 'corrupted_media/media.damaged'
 WHEN f = 'ogg' THEN 'unsupported_format/media.unsupported_container' WHEN f <> CASE WHEN page_id % 5 = 1 THEN 'mkv' ELSE 'mp4' END THEN 'wrong_extension/media.wrong_extension' WHEN v = 0 AND c > 0 THEN 'no_video/media.no_video_cover' WHEN v = 0 AND a > 0 THEN 'no_video/media.no_video_audio_only' WHEN v = 0 THEN 'no_video/media.no_video_empty'
 WHEN codec = '' THEN 'unsupported_codec/media.unknown_codec' WHEN w = 0 THEN 'corrupted_media/media.invalid_video_info' WHEN head = 0 THEN 'unsupported_codec/media.undecodable' WHEN tail < n / 100.0 - 2 THEN 'corrupted_media/media.incomplete' END AS x FROM pb)""", _PROBE))
def _(spark, d):
    n, size = F.col("page_id"), F.length("html")
    ext = F.element_at(F.array(*map(F.lit, (".mp4", ".MKV", ".avi", ".mp4", ".mp4"))), (n % 5 + 1).cast("int"))
    rows = _t(spark, d, "pages").select(
        "page_id", F.concat("url", ext).alias("path"), F.when(n % 13 == 0, None).when(n % 11 == 0, 0).otherwise(size).alias("length"), (n % 17 > 0).alias("probe_ok"), F.when(n % 7 == 0, "mkv").when(n % 7 == 1, "ogg").when(n % 5 == 1, "mkv").otherwise("mp4").alias("format_name"),
        F.when(n % 6 == 0, 0).otherwise(1).alias("n_video"), F.when(n % 12 == 0, 1).otherwise(0).alias("n_cover"), F.when(n % 18 == 0, 1).otherwise(0).alias("n_audio"), F.when(n % 19 == 0, "").otherwise("h264").alias("codec"), (n % 23).alias("width"), F.lit(90).alias("height"), F.lit(60.0).alias("duration_s"),
        F.when(n % 21 == 0, 0).otherwise(9).alias("head_frames"), (size / 100.0 - F.when(n % 10 == 3, 5).otherwise(0)).alias("tail_last_s"), (size / 100.0).alias("video_s"),
    )
    return vd.media_quality(rows, {".mp4": "mp4", ".mkv": "mkv"}).select("page_id", "category", "code")


@register("p23_to_manifest", "SELECT doc_id::VARCHAR AS item_id, source AS group_id, 'test' AS split, n_chars * 1000 AS duration_us, 'missing' AS video_label, 'unreviewed' AS review_basis, 'nudity=unknown,sexual_activity=unknown,sexual_context=unknown' AS labels, CASE WHEN lang IS NULL THEN 'n_chars=' || n_chars ELSE 'lang=' || lang || ',n_chars=' || n_chars END AS provenance, false AS excluded FROM documents")
def _(spark, d):
    fields = {"item_id": F.col("doc_id").cast("string"), "group_id": F.col("source"), "duration_us": F.col("n_chars") * 1000}
    rows = ct.to_manifest(_t(spark, d, "documents"), fields, ("lang", "n_chars"))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("item_id", "group_id", "split", "duration_us", "video_label", "review_basis", text("category_labels").alias("labels"), text("provenance").alias("provenance"), "excluded")


# --- selection

_HASH = "sha256('s|' || item_id)"


@register("b11_stratified_select", duck("""SELECT item_id, group_id, stratum FROM one UNION ALL SELECT item_id, group_id, stratum FROM two""", """src AS (SELECT item_id, 'g' || item_id % 60 AS group_id, toxic FROM items),
one AS (SELECT arg_min(item_id, sha256('s|video|' || item_id)) AS item_id, group_id, 'toxic' AS stratum FROM src WHERE toxic = 1 GROUP BY group_id ORDER BY sha256('s|prompt|' || group_id) LIMIT 5),
two AS (SELECT arg_min(item_id, sha256('s|video|' || item_id)) AS item_id, group_id, 'clean' AS stratum FROM src WHERE toxic = 0 AND group_id NOT IN (SELECT group_id FROM one) GROUP BY group_id ORDER BY sha256('s|prompt|' || group_id) LIMIT 7)"""))
def _(spark, d):
    rows = standin(spark, d, "items").select("item_id", F.concat(F.lit("g"), (F.col("item_id") % 60).cast("string")).alias("group_id"), "toxic")
    return sl.stratified_select(rows, [("toxic", F.col("toxic") == 1, 5), ("clean", F.col("toxic") == 0, 7)], seed="s", ident="item_id", group="group_id")


# a greedy walk through the hashes, the counts of subjects taken so far in a map
_GREEDY = f"""wk AS (SELECT item_id, subject, stratum, CASE stratum WHEN 'hard' THEN 8 ELSE 12 END AS target, row_number() OVER (ORDER BY stratum = 'ordinary', {_HASH}, item_id) AS n FROM (SELECT item_id, 'p' || item_id % 9 AS subject, CASE WHEN toxic = 1 THEN 'hard' ELSE 'ordinary' END AS stratum FROM items)),
gr AS (WITH RECURSIVE g AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS item_id, NULL::VARCHAR AS stratum, []::VARCHAR[] AS used, []::VARCHAR[] AS kinds, false AS took
  UNION ALL SELECT wk.n, wk.item_id, wk.stratum, CASE WHEN ok THEN list_append(used, subject) ELSE used END, CASE WHEN ok THEN list_append(kinds, wk.stratum) ELSE kinds END, ok FROM (SELECT w.*, g.used, g.kinds, len(list_filter(g.used, lambda x: x = w.subject)) < 3 AND len(list_filter(g.kinds, lambda x: x = w.stratum)) < w.target AS ok FROM g JOIN wk w ON w.n = g.n + 1) wk) SELECT * FROM g)"""


@register("b12_capped_select", duck("SELECT item_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY n) AS place FROM gr WHERE took", _GREEDY))
def _(spark, d):
    rows = standin(spark, d, "items").select("item_id", F.concat(F.lit("p"), (F.col("item_id") % 9).cast("string")).alias("subject"), "toxic")
    hard, ordinary = sl.split_total(20, 0.4)
    return sl.capped_select(rows, [("hard", F.col("toxic") == 1, hard), ("ordinary", F.col("toxic") == 0, ordinary)], cap=3, seed="s", ident="item_id", subject="subject").select("item_id", "stratum", "place")


_AUDIT = f"""au AS (SELECT item_id, CASE WHEN toxic = 1 THEN 'alert' WHEN quality = 0 THEN 'poor' END AS reason FROM items), ar AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL ORDER BY {_HASH}) AS r, count(*) OVER (PARTITION BY reason IS NULL) AS n FROM au),
ab AS (SELECT item_id, coalesce(reason, CASE WHEN r <= greatest(10, round_even(0.1 * n, 0)) THEN 'random_audit' ELSE 'complement' END) AS selection FROM ar)"""


@register("b13_audit_sample", duck("SELECT item_id, selection, batch, 'R' || lpad(p::VARCHAR, greatest(3, length(p::VARCHAR))::INT, '0') AS review_id FROM (SELECT *, row_number() OVER (ORDER BY batch, sha256('s|order|' || item_id), item_id) AS p FROM (SELECT *, CASE WHEN selection = 'complement' THEN 2 ELSE 1 END AS batch FROM ab))", _AUDIT))
def _(spark, d):
    why = {"alert": F.col("toxic") == 1, "poor": F.col("quality") == 0}
    out = sl.audit_sample(standin(spark, d, "items"), why, share=0.1, least=10, seed="s", ident="item_id")
    return sl.review_key(out, "item_id")


@register("b13_review_sheet", duck("SELECT 'R' || lpad(p::VARCHAR, greatest(3, length(p::VARCHAR))::INT, '0') AS review_id, batch, n_chars FROM (SELECT *, row_number() OVER (ORDER BY batch, sha256('s|order|' || item_id), item_id) AS p FROM (SELECT *, CASE WHEN selection = 'complement' THEN 2 ELSE 1 END AS batch FROM ab) JOIN (SELECT item_id, n_chars FROM items) USING (item_id))", _AUDIT))
def _(spark, d):
    why = {"alert": F.col("toxic") == 1, "poor": F.col("quality") == 0}
    return sl.review_sheet(sl.audit_sample(standin(spark, d, "items"), why, share=0.1, least=10, seed="s", ident="item_id"), ["n_chars"])


@register("b14_comparison_sample", duck("SELECT media_id, interval_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ('0x' || substr(sha256('s|' || interval_id), 1, 8))::BIGINT, interval_id) AS n FROM truth) WHERE category = 'red' OR n <= 2"))
def _(spark, d):
    return sl.comparison_sample(standin(spark, d, "truth"), ["red"], most=2, seed="s", ident="interval_id").select("media_id", "interval_id", "category")


# --- catalogues

_SEG = """sg AS (SELECT 'a' || l_orderkey % 5 AS action, l_orderkey AS item_id, CASE l_linenumber % 3 WHEN 0 THEN 'nudity' WHEN 1 THEN 'gender' ELSE 'relationship' END AS attribute, (l_linenumber - 1) * 40 AS first_frame, (l_linenumber - 1) * 40 + l_quantity::INT - 1 AS last_frame, list_sort(list_distinct([(l_partkey % 3)::INT, (l_suppkey % 3)::INT])) AS vals FROM lineitem),
mem AS (SELECT 'a' || o_orderkey % 5 AS action, o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 < 4)"""


def _segments(spark, d):
    k, first = F.col("l_orderkey"), ((F.col("l_linenumber") - 1) * 40).cast("int")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "nudity").when(F.col("l_linenumber") % 3 == 1, "gender").otherwise("relationship")
    values = F.array_sort(F.array_distinct(F.array((F.col("l_partkey") % 3).cast("int"), (F.col("l_suppkey") % 3).cast("int"))))
    return _t(spark, d, "lineitem").select(F.concat(F.lit("a"), (k % 5).cast("string")).alias("action"), k.alias("item_id"), kind.alias("attribute"), first.alias("first_frame"), (first + F.col("l_quantity").cast("int") - 1).alias("last_frame"), values.alias("values"))


def _members(spark, d):
    return _t(spark, d, "orders").where("o_orderstatus = 'F' and o_orderkey % 5 < 4").select(F.concat(F.lit("a"), (F.col("o_orderkey") % 5).cast("string")).alias("action"), F.col("o_orderkey").alias("item_id"))


@register("a28_attribute_catalogue", duck("""SELECT action, item_id, EXISTS (SELECT 1 FROM mem WHERE mem.item_id = c.item_id) AS in_archive, annotated_frames, extent_frames, level_frames, round(level_frames / annotated_frames, 4) AS fraction, round(level_frames / 30.0::DOUBLE, 3) AS level_s, round(r[1].a / 30.0::DOUBLE, 3) AS first_level_s,
 array_to_string(list_transform(r, lambda x: x.a || '-' || x.b), ';') AS segments, level_frames = annotated_frames AND len(r) = 1 AS whole, coalesce(array_to_string(list_sort(list_distinct(flatten(g))), '|'), '') AS values, flagged FROM (SELECT action, item_id, max(list_max(vals)) FILTER (attribute = 'nudity') AS top, sum(last_frame - first_frame + 1) FILTER (attribute = 'nudity')::BIGINT AS annotated_frames, (max(last_frame) - min(first_frame) + 1)::BIGINT AS extent_frames,
 sum(last_frame - first_frame + 1) FILTER (attribute = 'nudity' AND list_contains(vals, 2))::BIGINT AS level_frames, list({'a': first_frame, 'b': last_frame} ORDER BY first_frame, last_frame) FILTER (attribute = 'nudity' AND list_contains(vals, 2)) AS r, list(vals) FILTER (attribute = 'gender') AS g, coalesce(bool_or(attribute = 'relationship' AND list_contains(vals, 1)), false) AS flagged FROM sg GROUP BY 1, 2) c WHERE top = 2""", _SEG))
def _(spark, d):
    return ct.attribute_catalogue(_segments(spark, d), _members(spark, d), attribute="nudity", level=2, values_of="gender", flag=("relationship", 1))


@register("a28_catalogue_rollup", duck("SELECT action, count(*) AS annotated, count(*) FILTER (top = 0) AS level_0, count(*) FILTER (top = 1) AS level_1, count(*) FILTER (top = 2) AS level_2, count(*) FILTER (top = 2 AND m) AS in_archive, action IN (SELECT action FROM mem) AS archive_present FROM (SELECT action, item_id, max(list_max(vals)) FILTER (attribute = 'nudity') AS top, item_id IN (SELECT item_id FROM mem) AS m FROM sg GROUP BY 1, 2) GROUP BY 1", _SEG))
def _(spark, d):
    return ct.catalogue_rollup(_segments(spark, d), _members(spark, d), attribute="nudity", level=2)


_ISSUE = """oi AS (SELECT *, lag(last_frame) OVER w AS p FROM sg WINDOW w AS (PARTITION BY action, item_id, attribute ORDER BY first_frame, last_frame)),
ends AS (SELECT action, item_id, attribute, max(last_frame) AS e FROM (SELECT *, row_number() OVER (PARTITION BY action, item_id, attribute ORDER BY first_frame DESC, last_frame DESC) AS r FROM sg) WHERE r = 1 GROUP BY 1, 2, 3),
iss AS (SELECT action, item_id, attribute, CASE WHEN p IS NULL AND first_frame <> 0 THEN 'does not start at 0' WHEN first_frame <= p THEN 'overlap' WHEN first_frame > p + 1 THEN 'gap' END AS issue FROM oi WHERE (p IS NULL AND first_frame <> 0) OR first_frame <> p + 1
  UNION ALL SELECT action, item_id, NULL, 'ends differ' FROM ends GROUP BY 1, 2 HAVING min(e) <> max(e))"""


@register("w06_annotation_issues", duck("SELECT action, attribute, issue, count(*) AS n FROM iss GROUP BY 1, 2, 3", f"{_SEG}, {_ISSUE}"))
def _(spark, d):
    found = ct.annotation_issues(_segments(spark, d), ["action", "item_id", "attribute"], attribute="attribute")
    return found.groupBy("action", "attribute", "issue").agg(F.count("*").alias("n"))


@register("a17_inventory", duck("SELECT action, count(*) AS annotated, count(*) FILTER (top = 0) AS level_0, count(*) FILTER (top = 1) AS level_1, count(*) FILTER (top = 2) AS level_2, count(*) FILTER (item_id % 7 = 0) AS review_true, count(*) FILTER (item_id IN (SELECT item_id FROM iss)) AS with_issues FROM (SELECT action, item_id, max(list_max(vals)) FILTER (attribute = 'nudity') AS top FROM sg GROUP BY 1, 2) GROUP BY 1", f"{_SEG}, {_ISSUE}"))
def _(spark, d):
    s = _segments(spark, d)
    reviews = s.select("action", "item_id", (F.col("item_id") % 7 == 0).alias("review"))
    return ct.inventory(s, reviews, ct.annotation_issues(s, ["action", "item_id", "attribute"], attribute="attribute"), attribute="nudity")


_SPEECH = "CASE event_type WHEN 'view' THEN 'whisper_model_load' WHEN 'signup' THEN 'whisper_probe' WHEN 'click' THEN 'other' ELSE 'whisper_transcription' END"


def _speech(spark, d):
    n = F.col("sample_id")
    return standin(spark, d, "samples").select("media_id", "sample_id", F.expr(_SPEECH).alias("kind"), F.when(n % 4 == 1, None).otherwise(n % 4).cast("int").alias("segments"), F.when(n % 3 == 0, "en").otherwise("de").alias("language"), F.lit(0.5).alias("language_probability"), (n % 5 == 0).alias("available"), (n % 6 > 0).alias("ok"))


@register("a30_speech_summary", duck(f"SELECT sample_id, s > 0 AS speech_present, CASE WHEN s > 0 THEN l END AS language, CASE WHEN s > 0 THEN 0.5::DOUBLE END AS language_probability, CASE WHEN s > 0 THEN 'speech_segments' ELSE 'no_speech_segments_unreliable' END AS language_basis, CASE WHEN s = 0 THEN l END AS detected_without_speech FROM (SELECT sample_id, CASE WHEN sample_id % 4 = 1 THEN 0 ELSE sample_id % 4 END AS s, CASE WHEN sample_id % 3 = 0 THEN 'en' ELSE 'de' END AS l FROM samples WHERE {_SPEECH} = 'whisper_transcription')"))
def _(spark, d):
    return ct.speech_summary(_speech(spark, d)).select("sample_id", "speech_present", "language", "language_probability", "language_basis", "detected_without_speech")


@register("a30_probe_summary", duck(f"SELECT media_id, bool_or(sample_id % 5 = 0) FILTER (k = 'whisper_probe') AS probe_available, count(*) FILTER (k = 'whisper_model_load') AS model_loads, count(*) FILTER (k = 'whisper_model_load' AND sample_id % 6 > 0) AS loaded, count(*) FILTER (k = 'whisper_transcription' AND sample_id % 4 > 1) AS with_speech, count(*) FILTER (k = 'whisper_transcription' AND sample_id % 4 < 2) AS without_speech FROM (SELECT *, {_SPEECH} AS k FROM samples) GROUP BY 1 HAVING count(*) FILTER (k = 'whisper_probe') > 0"))
def _(spark, d):
    return ct.probe_summary(_speech(spark, d), ["media_id"])


@register("a16_compare_models", duck("SELECT l_linenumber AS metric, round(avg(completed::INT) FILTER (config = 'A'), 9) AS \"A\", round(avg(completed::INT) FILTER (config = 'R'), 9) AS \"R\", round(avg(completed::INT) FILTER (config = 'N'), 9) AS \"N\", round(avg(completed::INT) FILTER (config = 'N') - avg(completed::INT) FILTER (config = 'A'), 9) AS \"delta_A\", round(avg(completed::INT) FILTER (config = 'N') - avg(completed::INT) FILTER (config = 'R'), 9) AS \"delta_R\" FROM attempts GROUP BY 1"))
def _(spark, d):
    a = standin(spark, d, "attempts").groupBy(F.col("l_linenumber").alias("metric"), F.col("config").alias("model")).agg(F.avg(F.col("completed").cast("int")).alias("value"))
    out = ct.compare_models(a, ["A", "R"], current="N")
    return out.select("metric", *[F.round(c, 9).alias(c) for c in out.columns if c != "metric"])


# --- runs

_KIND = "CASE event_type WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN CASE WHEN sample_id % 2 = 0 THEN 'failed' ELSE 'cancelled' END WHEN 'view' THEN 'invalid' END"
_JOURNAL = f"""jn AS (SELECT media_id, sample_id % 20 AS batch, {_KIND} AS kind, sample_id AS seq FROM samples WHERE sample_id % 20 < 17),
jb AS (SELECT media_id, batch, bool_or(kind = 'started') AS began, arg_max(kind, seq) FILTER (kind IN ('completed', 'failed', 'cancelled')) AS fin, max(seq) FILTER (kind IN ('completed', 'failed', 'cancelled')) AS ended, min(seq) FILTER (kind = 'invalid') AS bad FROM jn GROUP BY 1, 2),
jp AS (SELECT DISTINCT media_id, sample_id % 20 AS batch FROM samples WHERE sample_id % 20 > 2 AND media_id % 3 > 0),
jx AS (SELECT coalesce(jb.media_id, jp.media_id) AS media_id, began, fin, ended, bad, jp.media_id IS NOT NULL AS known FROM jb FULL JOIN jp ON jb.media_id = jp.media_id AND jb.batch = jp.batch)"""


@register("a26_batch_reliability", duck("SELECT media_id, nullif(count(*) FILTER (known), 0) AS planned, count(*) FILTER (began) AS started, CASE WHEN count(*) FILTER (known) > 0 THEN count(*) FILTER (known AND NOT coalesce(began, false)) END AS unprocessed, count(*) FILTER (began AND fin IS NULL) AS unfinished, count(*) FILTER (fin = 'completed') AS completed, count(*) FILTER (fin = 'failed') AS failed, count(*) FILTER (fin = 'cancelled') AS cancelled, count(*) FILTER (bad < ended) AS invalid, count(*) FILTER (bad < ended AND fin = 'completed') AS repaired FROM jx GROUP BY 1", _JOURNAL))
def _(spark, d):
    s = standin(spark, d, "samples").withColumn("batch", F.col("sample_id") % 20)
    events = s.where("batch < 17").select("media_id", "batch", F.expr(_KIND).alias("kind"), F.col("sample_id").alias("seq"))
    return rn.batch_reliability(s.where("batch > 2 and media_id % 3 > 0").select("media_id", "batch"), events, ["media_id"])


@register("a27_stage_spans", duck("SELECT media_id, event_type, max(ts_us) - min(ts_us) AS span, count(*) AS n, NOT bool_or(coalesce(ts_us < p, false)) AS in_order FROM (SELECT *, lag(ts_us) OVER (PARTITION BY media_id, event_type ORDER BY sample_id) AS p FROM samples) GROUP BY 1, 2"))
def _(spark, d):
    return rn.stage_spans(standin(spark, d, "samples"), ["media_id", "event_type"], "ts_us", seq="sample_id")


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, config ORDER BY at_us DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, cents DESC) AS n FROM attempts) WHERE n = 1)"


@register("j13_compare_runs", duck(f"SELECT item_id, count(DISTINCT coalesce(completed::VARCHAR, '?')) = 1 AS same_completed, count(DISTINCT coalesce(cents::VARCHAR, '?')) = 1 AS same_cents, count(DISTINCT coalesce(completed::VARCHAR, '?')) = 1 AND count(DISTINCT coalesce(cents::VARCHAR, '?')) = 1 AS same FROM {_LAST} GROUP BY 1 HAVING count(DISTINCT config) = 3"))
def _(spark, d):
    last = rn.latest_attempt(standin(spark, d, "attempts"), ("item_id", "config"), ("at_us", "l_linenumber", "l_partkey", "l_suppkey", "cents"))
    return rn.compare_runs({c: last.where(F.col("config") == c) for c in ("A", "N", "R")}, ["item_id"], ["completed", "cents"])
