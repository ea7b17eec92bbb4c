"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from .registry import register
from .standins import duck, standin

_T = "CASE WHEN sample_id % 7 = 0 THEN 'junk' ELSE printf('%02d:%02d:%02d.%d', (sample_id % 30)::INT, (sample_id % 60)::INT, (sample_id % 59)::INT, (sample_id % 10000)::INT) END"


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@register("f01_timecode_to_us", duck("SELECT media_id, sample_id, CASE WHEN sample_id % 7 = 0 THEN NULL ELSE ((sample_id % 30) * 3600 + (sample_id % 60) * 60 + (sample_id % 59)) * 1000000 + round(('0.' || (sample_id % 10000))::DECIMAL(18,9) * 1000, 0)::BIGINT * 1000 END AS us FROM samples"))
def _(spark, d):
    n = F.col("sample_id")
    text = F.when(n % 7 == 0, "junk").otherwise(F.format_string("%02d:%02d:%02d.%d", n % 30, n % 60, n % 59, n % 10000))
    return standin(spark, d, "samples").select("media_id", "sample_id", fn.timecode_to_us(text).alias("us"))


@register("f02_us_to_timecode", duck("SELECT media_id, sample_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS timecode FROM (SELECT *, (ts_us + 500) // 1000 AS ms FROM samples)"))
def _(spark, d):
    return standin(spark, d, "samples").select("media_id", "sample_id", fn.us_to_timecode(F.col("ts_us")).alias("timecode"))


@register("f03_parse_fraction", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN l_quantity WHEN 2 THEN round(l_quantity / nullif(l_suppkey % 5, 0), 9) ELSE NULL END AS value FROM lineitem")
def _(spark, d):
    q = F.col("l_quantity").cast("string")
    text = F.element_at(F.array(F.lit("a/b"), q, F.concat_ws("/", q, (F.col("l_suppkey") % 5).cast("string")), F.lit("1/2/3")), F.col("l_linenumber") % 4 + 1)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(fn.parse_fraction(text), 9).alias("value"))


@register("f04_pts_to_us", "SELECT o_orderkey, (2 * (o_orderkey * 1001 * 1000000) + 30000) // 60000 AS us FROM orders")
def _(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", fn.pts_to_us(F.col("o_orderkey"), F.lit(1001), F.lit(30000)).alias("us"))


@register("f05_excerpt", r"SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 79), ' ') || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS t FROM documents)")
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", fn.excerpt(F.col("text"), 80).alias("excerpt"))


@register("f06_clean_cue", r"SELECT conv_id, turn, trim(text, ' ') || chr(10) || 'a & b' AS cue FROM conversations")
def _(spark, d):
    raw = F.concat(F.lit("{\\an8}<i>"), F.col("text"), F.lit("</i>\\Na &amp; b"))
    return _table(spark, d, "conversations").select("conv_id", "turn", fn.clean_cue(raw).alias("cue"))


@register("f07_safe_id", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 24) AS safe FROM pages")
def _(spark, d):
    return _table(spark, d, "pages").select("page_id", fn.safe_id(F.col("url"), 24).alias("safe"))


@register("f08_suggestion_id", duck("SELECT media_id, interval_id, 'suggestion-' || substr(sha256(media_id || '|' || printf('%d.%03d', (start_us + 500) // 1000000, (start_us + 500) // 1000 % 1000) || '|' || printf('%d.%03d', (end_us + 500) // 1000000, (end_us + 500) // 1000 % 1000) || '|' || category), 1, 20) AS id FROM truth"))
def _(spark, d):
    rows = standin(spark, d, "truth")
    return rows.select("media_id", "interval_id", fn.suggestion_id(F.col("media_id").cast("string"), F.col("start_us"), F.col("end_us"), F.col("category")).alias("id"))


@register("f09_combined_confidence", duck("SELECT media_id, sample_id, round(least(1.0, a + (1 - a) * 0.12 * b + CASE WHEN scene THEN (1 - a) * 0.04 ELSE 0 END), 9) AS confidence FROM samples"))
def _(spark, d):
    return standin(spark, d, "samples").select("media_id", "sample_id", F.round(fn.combined_confidence(F.col("a").cast("double"), F.col("b").cast("double"), F.col("scene")), 9).alias("confidence"))


@register("f10_hamming", "SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::INT AS bits FROM orders")
def _(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", fn.hamming(F.col("o_orderkey"), F.col("o_custkey")).alias("bits"))


@register("f11_difference_hash", "SELECT vec_id, list_sum(list_transform(range(56), lambda i: CASE WHEN embedding[(i // 7) * 8 + i % 7 + 1] > embedding[(i // 7) * 8 + i % 7 + 2] THEN 1::BIGINT << (55 - i)::INT ELSE 0 END))::BIGINT AS hash FROM embeddings")
def _(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", fn.difference_hash(F.col("embedding"), 8, 8).alias("hash"))


@register("f12_cosine", "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e, embeddings f WHERE f.vec_id = 0")
def _(spark, d):
    e = _table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("f"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(fn.cosine(F.col("embedding"), F.col("f")), 6).alias("cosine"))


@register("f13_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS place FROM embeddings")
def _(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", fn.argmax(F.col("embedding")).alias("place"))


@register("f14_canonical", "SELECT o_orderkey, nullif(lower(trim(CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END)), '') AS key FROM orders""")
def _(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return _table(spark, d, "orders").select("o_orderkey", fn.canonical(text).alias("key"))


@register("f15_parse_events", duck("SELECT media_id, interval_id, start_us AS first_us, category, 2 AS n FROM truth"))
def _(spark, d):
    text = F.concat(F.col("start_us"), F.lit("-"), F.col("end_us"), F.lit(":"), F.col("category"), F.lit("; x ;"))
    rows = standin(spark, d, "truth").withColumn("e", fn.parse_events(text))
    return rows.select("media_id", "interval_id", F.col("e")[0]["start"].alias("first_us"), F.col("e")[0]["category"].alias("category"), F.size("e").alias("n"))


@register("f16_parse_name", r"SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\d+)', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\d+)', 3) AS section FROM pages")
def _(spark, d):
    p = r"^(https?)://([^/]+)/([a-z]+)/(\d+)"
    return _table(spark, d, "pages").select("page_id", F.regexp_extract("url", p, 2).alias("host"), F.regexp_extract("url", p, 3).alias("section"))


@register("f17_first_json_object", duck("SELECT media_id, sample_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev"))
def _(spark, d):
    said = F.concat(F.lit("Answer {so} is: {"), F.lit('"no": "}{", "in": '), F.col("props"), F.lit("} and {more}"))
    return standin(spark, d, "ev").select("media_id", "sample_id", F.get_json_object(fn.first_json_object(said), "$.in.k").cast("bigint").alias("k"))


@register("f18_parse_answers", duck("SELECT media_id, sample_id, CASE sample_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS answer, CASE WHEN sample_id % 3 = 2 THEN NULL WHEN sample_id % 2 = 1 THEN ['a', 'c'] ELSE ['b', 'c'] END AS categories FROM samples"), arrays=("categories",))
def _(spark, d):
    n = F.col("sample_id")
    answer = F.when(n % 3 == 0, " Yes. ").when(n % 3 == 1, "NO").otherwise("yes and no")
    bits = F.when(n % 3 == 2, "10").when(n % 2 == 1, "101").otherwise("011")
    return standin(spark, d, "samples").select("media_id", "sample_id", fn.parse_binary_answer(answer).alias("answer"), fn.parse_bitmask(bits, ("a", "b", "c")).alias("categories"))


@register("f19_iou_pairs", duck("SELECT p.media_id, p.interval_id, t.interval_id AS r_interval_id, round((least(p.end_us, t.end_us) - greatest(p.start_us, t.start_us)) / (p.end_us - p.start_us + t.end_us - t.start_us - least(p.end_us, t.end_us) + greatest(p.start_us, t.start_us)), 9) AS iou FROM predicted p JOIN truth t ON p.media_id = t.media_id WHERE p.start_us < t.end_us AND t.start_us < p.end_us"))
def _(spark, d):
    from ..operators.matching import pair_iou
    from .standins import HOUR

    return pair_iou(standin(spark, d, "predicted"), standin(spark, d, "truth"), width=2 * HOUR).select("media_id", "interval_id", "r_interval_id", F.round("iou", 9).alias("iou"))


@register("f20_language_name", "SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END, lang) AS language FROM documents")
def _(spark, d):
    names = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French")], "lang string, language string")
    return _table(spark, d, "documents").select("doc_id", "lang").join(F.broadcast(names), "lang", "left").select("doc_id", F.coalesce("language", "lang").alias("language"))


_Z = 1.959963984540054


@register("f21_wilson", duck(f"SELECT media_id, round((p + {_Z * _Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n), 9) AS low, round((p + {_Z * _Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) / (1 + {_Z * _Z} / n), 9) AS high FROM (SELECT media_id, count(*)::DOUBLE AS n, count(*) FILTER (scene) / count(*)::DOUBLE AS p FROM samples GROUP BY 1)"))
def _(spark, d):
    rows = standin(spark, d, "samples").groupBy("media_id").agg(F.count("*").alias("n"), F.count_if("scene").alias("k"))
    low, high = fn.wilson(F.col("k"), F.col("n"))
    return rows.select("media_id", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@register("f22_ratio", duck("SELECT media_id, round(count(*) FILTER (scene) / nullif(count(*) FILTER (event_type = 'error'), 0), 9) AS ratio FROM samples GROUP BY 1"))
def _(spark, d):
    return standin(spark, d, "samples").groupBy("media_id").agg(F.round(fn.ratio(F.count_if("scene"), F.count_if(F.col("event_type") == "error")), 9).alias("ratio"))


def _redacted(text):
    """DuckDB SQL of redact: RE2 looks at the character before instead of behind itself."""
    text = rf"regexp_replace({text}, '(?i)\b(token|secret|password|api_key)[ \t\n\v\f\r]*[=:][ \t\n\v\f\r]*[^ \t\n\v\f\r]+', '\1=[redacted]', 'g')"
    text = rf"regexp_replace({text}, '(?i)\b(sk[-_][A-Za-z0-9_-]{{10,}}|lsv2_pt_[A-Za-z0-9_-]{{10,}}|ls__[A-Za-z0-9_-]{{10,}})\b', '[redacted]', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '(?i)(^|[^a-z])[a-z]:[\\/][^\r\n]*', '\1[path]', 'g'), '\\\\[^\r\n]*', '[path]', 'g')"
    return rf"regexp_replace({text}, '(?i)(^|[^\w.])/(home|users|root|tmp|var|private|mnt)/[^\r\n]*', '\1[path]', 'g')"


_ODD = "CASE doc_id % 6 WHEN 0 THEN 'token: abc' || doc_id || ' in /home/user/x' WHEN 1 THEN 'key sk-abcdefghijk' || doc_id || ' end' WHEN 2 THEN 'see C:\\Users\\bob smith\\x' WHEN 3 THEN 'in /tmp/a b' WHEN 4 THEN '\\\\srv\\share of x' ELSE 'a/var/x and ls__abcdefghijkl' END || chr(10) || coalesce(substr(text, 1, 40), '')"


@register("f23_redact", f"SELECT doc_id, substr({_redacted(_ODD)}, 1, 60) AS safe FROM documents")
def _(spark, d):
    n, lit = F.col("doc_id"), F.lit
    odd = F.when(n % 6 == 0, F.concat(lit("token: abc"), n.cast("string"), lit(" in /home/user/x"))).when(n % 6 == 1, F.concat(lit("key sk-abcdefghijk"), n.cast("string"), lit(" end"))).when(n % 6 == 2, lit("see C:\\Users\\bob smith\\x")).when(n % 6 == 3, lit("in /tmp/a b")).when(n % 6 == 4, lit("\\\\srv\\share of x")).otherwise(lit("a/var/x and ls__abcdefghijkl"))
    text = F.concat(odd, lit("\n"), F.coalesce(F.substring("text", 1, 40), lit("")))
    return _table(spark, d, "documents").select("doc_id", fn.redact(text, 60).alias("safe"))


_REDACTED = _redacted("text")


@register("f26_redact_whole", f"SELECT doc_id, substr({_REDACTED}, 1, 400) AS safe, md5({_REDACTED}) AS whole FROM documents")
def _(spark, d):
    text = F.col("text")
    return _table(spark, d, "documents").select("doc_id", fn.redact(text).alias("safe"), F.md5(fn.redact(text, 2**31 - 1).cast("binary")).alias("whole"))


@register("f24_aspect_ratio", "SELECT o_orderkey, CASE WHEN o_custkey > 0 AND o_orderkey > 0 THEN (o_custkey // gcd(o_custkey, o_orderkey)) || ':' || (o_orderkey // gcd(o_custkey, o_orderkey)) END AS aspect FROM orders")
def _(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", fn.aspect_ratio(F.col("o_custkey"), F.col("o_orderkey")).alias("aspect"))


@register("f25_uid", "SELECT o_orderkey, o_custkey || '::' || replace(o_orderpriority, ' ', '-') || '::' || o_orderkey AS uid FROM orders")
def _(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", fn.uid(F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("uid"))


@register("p19_frame_rate_mode", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity % 5 = 0 THEN 'undetermined' WHEN abs(l_tax) <= 0.005 THEN 'likely_cfr' ELSE 'likely_vfr' END AS mode FROM lineitem")
def _(spark, d):
    real = F.when(F.col("l_quantity") % 5 == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.frame_rate_mode(real + F.col("l_tax"), real).alias("mode"))


@register("p20_duration_band", duck("SELECT media_id, interval_id, CASE WHEN len < 3600 THEN '<3600' WHEN len < 7200 THEN '3600-7200' ELSE '>=7200' END AS band FROM (SELECT *, (end_us - start_us) / 1e6 AS len FROM truth)"))
def _(spark, d):
    return standin(spark, d, "truth").select("media_id", "interval_id", fn.band((F.col("end_us") - F.col("start_us")) / 1e6, (3600, 7200)).alias("band"))


@register("s16_content_key", """SELECT o_orderkey, sha256('{"a":' || o_custkey || ',"b":"' || o_orderstatus || '","c":null}') AS key FROM orders""")
def _(spark, d):
    key = fn.content_key({"b": F.col("o_orderstatus"), "a": F.col("o_custkey"), "c": F.lit(None).cast("string")})
    return _table(spark, d, "orders").select("o_orderkey", key.alias("key"))
