"""Timelines, scores, truth and predictions derived from the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOUR = 3_600_000_000
MINUTE = 60_000_000
_US = {"spark": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})", "duckdb": "epoch_us({0})"}

_CTES = """
ev AS (SELECT user_id AS media_id, event_id AS sample_id, {us:ts} AS abs_us, value, event_type, props FROM events),
media AS (SELECT media_id, min(abs_us) AS origin_us, max(abs_us) - min(abs_us) + 1000000 AS duration_us FROM ev GROUP BY media_id),
samples AS (SELECT e.media_id, e.sample_id, e.abs_us - m.origin_us AS ts_us, e.value / 500.0 AS a, ((e.sample_id * 7919) % 1000) / 1000.0 AS b,
  e.event_type = 'signup' AS scene, e.event_type, m.duration_us FROM ev e JOIN media m ON e.media_id = m.media_id),
truth AS (SELECT media_id, sample_id AS interval_id, greatest(0, ts_us - 3600000000) AS start_us, least(duration_us, ts_us + 3600000000) AS end_us,
  CASE sample_id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS category, CASE WHEN sample_id % 2 = 0 THEN 'high' ELSE 'low' END AS severity,
  duration_us FROM samples WHERE event_type = 'error'),
predicted AS (SELECT media_id, sample_id AS interval_id, greatest(0, ts_us - 3600000000) AS start_us, least(duration_us, ts_us + 3600000000) AS end_us,
  CASE sample_id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS category, a AS confidence, duration_us FROM samples WHERE event_type = 'purchase'),
marks AS (SELECT media_id, ts_us AS mark_us FROM samples WHERE event_type = 'view'),
segments AS (SELECT conv_id AS media_id, turn * 10000000 AS start_us, turn * 10000000 + 8000000 AS end_us, text, role FROM conversations),
attempts AS (SELECT l_orderkey AS item_id, l_returnflag AS config, l_linestatus = 'O' AS completed, {us:l_shipdate} AS at_us, l_linenumber, l_partkey, l_suppkey,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
packets AS (SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice) - 1 AS decode_pos,
  (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) * 40000 AS pts_us,
  l_returnflag = 'R' AS is_key, CAST(l_partkey AS VARCHAR(20)) AS data_hash FROM lineitem),
items AS (SELECT d.doc_id AS item_id, d.source AS group_id, l.toxic, l.quality, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""
TABLES = ("events", "conversations", "lineitem", "documents", "labels")


def _ctes(engine: str) -> str:
    text = _CTES
    for c in ("ts", "l_shipdate"):
        text = text.replace(f"{{us:{c}}}", _US[engine].format(c))
    return text


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables (ev, media, samples, truth, predicted, marks, segments, attempts, packets, items)."""
    text = _ctes("spark")
    used = [t for t in TABLES if f"FROM {t}" in text or f"JOIN {t}" in text]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **tables)


def duck(body: str, more: str = "") -> str:
    """DuckDB SQL over the derived tables; more holds further CTEs."""
    return f"WITH {_ctes('duckdb').strip()}{',' + more if more else ''} {body}"


def merged(source: str, gap: int = 0, extra: str = "", key: str = "media_id") -> str:
    """DuckDB SQL of the merged intervals of a relation."""
    return f"""(SELECT {key}, min(start_us) AS start_us, max(end_us) AS end_us{extra} FROM (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN start_us > max(end_us) OVER (PARTITION BY {key} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS fresh FROM {source})) GROUP BY {key}, island)"""


def inverted(source: str) -> str:
    """DuckDB SQL of what the merged intervals of a relation leave of each media."""
    m = merged(source)
    return f"""(SELECT media_id, s AS start_us, e AS end_us FROM (SELECT media_id, coalesce(lag(end_us) OVER (PARTITION BY media_id ORDER BY start_us), 0) AS s, start_us AS e FROM {m}
  UNION ALL SELECT media.media_id, coalesce(last, 0), duration_us FROM media LEFT JOIN (SELECT media_id, max(end_us) AS last FROM {m} GROUP BY media_id) x ON media.media_id = x.media_id) WHERE e > s)"""
