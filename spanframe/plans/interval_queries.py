"""Queries of the interval algebra and the joins over timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import timeline as tl
from .registry import register
from .standins import HOUR, duck, inverted, merged, standin

_PAD = "(SELECT media_id, greatest(0, start_us - 1800000000) AS start_us, least(duration_us, end_us + 1800000000) AS end_us, category FROM truth)"


@register("i01_merge_intervals", duck(f"SELECT * FROM {merged(_PAD, HOUR, ', count(*) AS n')}"))
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = standin(spark, d, "truth").withColumn("n", F.lit(1))
    return iv.merge_intervals(rows, pad=HOUR // 2, gap=HOUR, duration="duration_us", carry={"n": "sum"}, chunk=72 * HOUR)


@register("i02_invert_intervals", duck(f"SELECT * FROM {inverted('truth')}"))
def _(spark, d):
    return iv.invert_intervals(standin(spark, d, "truth").drop("duration_us"), standin(spark, d, "media"))


@register("i03_total_duration", duck(f"SELECT t.media_id, total_us, flagged_us FROM (SELECT media_id, sum(end_us - start_us)::BIGINT AS total_us FROM truth GROUP BY 1) t JOIN (SELECT media_id, sum(end_us - start_us)::BIGINT AS flagged_us FROM {merged('truth')} GROUP BY 1) f ON t.media_id = f.media_id"))
def _(spark, d):
    t = standin(spark, d, "truth")
    return iv.total_duration(t).join(iv.total_duration(t, overlap_aware=True).withColumnRenamed("total_us", "flagged_us"), "media_id")


_CUT = f"""x AS (SELECT p.media_id, p.interval_id, p.start_us, p.end_us, greatest(p.start_us, t.start_us) AS cs, least(p.end_us, t.end_us) AS ce FROM predicted p JOIN {merged('truth')} t
  ON p.media_id = t.media_id AND p.start_us < t.end_us AND t.start_us < p.end_us),
fragments AS (SELECT media_id, interval_id, s AS start_us, e AS end_us FROM (SELECT media_id, interval_id, coalesce(lag(ce) OVER w, start_us) AS s, cs AS e FROM x WINDOW w AS (PARTITION BY media_id, interval_id ORDER BY cs)
  UNION ALL SELECT media_id, interval_id, max(ce), max(end_us) FROM x GROUP BY 1, 2
  UNION ALL SELECT media_id, interval_id, start_us, end_us FROM predicted WHERE (media_id, interval_id) NOT IN (SELECT (media_id, interval_id) FROM x)) WHERE e > s)"""


@register("i04_subtract_intervals", duck("SELECT media_id, interval_id, start_us, end_us FROM fragments", _CUT))
def _(spark, d):
    return iv.subtract_intervals(standin(spark, d, "predicted"), standin(spark, d, "truth"), width=2 * HOUR).select("media_id", "interval_id", "start_us", "end_us")


@register("i05_intersect_intervals", duck("SELECT p.media_id, p.interval_id, t.interval_id AS r_interval_id, greatest(p.start_us, t.start_us) AS overlap_start_us, least(p.end_us, t.end_us) AS overlap_end_us FROM predicted p JOIN truth t ON p.media_id = t.media_id WHERE p.start_us < t.end_us AND t.start_us < p.end_us"))
def _(spark, d):
    out = iv.intersect_intervals(standin(spark, d, "predicted"), standin(spark, d, "truth"), width=2 * HOUR)
    return out.select("media_id", "interval_id", "r_interval_id", "overlap_start_us", "overlap_end_us")


_DUR = "(SELECT media_id, sum(end_us - start_us)::BIGINT AS {0} FROM {1} GROUP BY 1)"


@register("i06_iou", duck(f"""SELECT coalesce(p.media_id, t.media_id) AS media_id, coalesce(a_us, 0) AS a_us, coalesce(b_us, 0) AS b_us, coalesce(both_us, 0) AS both_us,
  round(coalesce(coalesce(both_us, 0) / nullif(coalesce(a_us, 0) + coalesce(b_us, 0) - coalesce(both_us, 0), 0), 0.0), 9) AS iou
  FROM {_DUR.format('a_us', merged('predicted'))} p FULL JOIN {_DUR.format('b_us', merged('truth'))} t ON p.media_id = t.media_id
  LEFT JOIN (SELECT p.media_id, sum(least(p.end_us, t.end_us) - greatest(p.start_us, t.start_us))::BIGINT AS both_us FROM {merged('predicted')} p JOIN {merged('truth')} t
  ON p.media_id = t.media_id AND p.start_us < t.end_us AND t.start_us < p.end_us GROUP BY 1) c ON coalesce(p.media_id, t.media_id) = c.media_id"""))
def _(spark, d):
    return iv.iou(standin(spark, d, "predicted"), standin(spark, d, "truth"), width=4 * HOUR).withColumn("iou", F.round("iou", 9))


_SHIFT = "coalesce((SELECT sum(least(m.end_us, {0}) - m.start_us) FROM gone m WHERE m.media_id = {1}.media_id AND m.start_us <= {0}), 0)::BIGINT"
_GONE = f"gone AS {merged('truth')}"


@register("i07_remap_after_deletion", duck(f"SELECT media_id, sample_id, ts_us, ts_us - {_SHIFT.format('s.ts_us', 's')} AS remapped_us FROM samples s", _GONE))
def _(spark, d):
    return iv.remap_after_deletion(standin(spark, d, "samples"), standin(spark, d, "truth")).select("media_id", "sample_id", "ts_us", "remapped_us")


@register("i08_rebuild_spans", duck(f"SELECT * FROM (SELECT media_id, interval_id, start_us - {_SHIFT.format('f.start_us', 'f')} AS start_us, end_us - {_SHIFT.format('f.end_us', 'f')} AS end_us FROM fragments f) WHERE end_us > start_us", f"{_CUT}, {_GONE}"))
def _(spark, d):
    return iv.rebuild_spans(standin(spark, d, "predicted"), standin(spark, d, "truth"), width=2 * HOUR).select("media_id", "interval_id", "start_us", "end_us")


_PLAN = f"""kept AS {inverted('truth')},
k AS (SELECT kept.*, m.duration_us, (SELECT min(mark_us) FROM marks x WHERE x.media_id = kept.media_id AND mark_us >= kept.start_us) AS head,
  (SELECT max(mark_us) FROM marks x WHERE x.media_id = kept.media_id AND mark_us <= kept.end_us) AS tail FROM kept JOIN media m ON kept.media_id = m.media_id),
raw AS (SELECT media_id, start_us AS kept_id, start_us, least(coalesce(head, end_us), end_us) AS end_us FROM k WHERE start_us > 0 AND head IS DISTINCT FROM start_us
  UNION ALL SELECT media_id, start_us, greatest(coalesce(tail, start_us), start_us), end_us FROM k WHERE end_us < duration_us AND tail IS DISTINCT FROM end_us),
again AS (SELECT * FROM {merged('(SELECT * FROM raw WHERE end_us > start_us)', 2000, key='media_id, kept_id')} WHERE end_us - start_us >= 1000),
bounds AS (SELECT media_id, kept_id, max(CASE WHEN first THEN end_us END) AS lo, min(CASE WHEN NOT first THEN start_us END) AS hi FROM (SELECT *, start_us = kept_id AS first FROM again) GROUP BY 1, 2)"""


@register("i09_cut_plan", duck(f"""SELECT media_id, 'delete' AS type, start_us, end_us FROM {merged('truth')} UNION ALL SELECT media_id, 'reencode', start_us, end_us FROM again
  UNION ALL SELECT media_id, 'copy', s, e FROM (SELECT k.media_id, coalesce(b.lo, k.start_us) AS s, coalesce(b.hi, k.end_us) AS e FROM k LEFT JOIN bounds b ON k.media_id = b.media_id AND k.start_us = b.kept_id) WHERE e - s >= 1000""", _PLAN))
def _(spark, d):
    return iv.cut_plan(standin(spark, d, "truth").drop("duration_us"), standin(spark, d, "marks"), standin(spark, d, "media"), width=24 * HOUR)


@register("i10_safe_cut", duck("""SELECT media_id, interval_id, start_us, end_us, coalesce(p, 0) AS safe_start_us, coalesce(n, duration_us) AS safe_end_us, p IS NULL OR n IS NULL AS no_key,
  start_us - coalesce(p, 0) AS extra_before_us, coalesce(n, duration_us) - end_us AS extra_after_us FROM (SELECT t.*, (SELECT max(mark_us) FROM marks m WHERE m.media_id = t.media_id AND mark_us <= t.start_us) AS p,
  (SELECT min(mark_us) FROM marks m WHERE m.media_id = t.media_id AND mark_us >= t.end_us) AS n FROM truth t)"""))
def _(spark, d):
    out = iv.safe_cut(standin(spark, d, "truth").drop("duration_us"), standin(spark, d, "marks"), standin(spark, d, "media"))
    return out.select("media_id", "interval_id", "start_us", "end_us", "safe_start_us", "safe_end_us", "no_key", "extra_before_us", "extra_after_us")


_ASK = "(SELECT o_custkey, o_orderkey, (o_orderkey % 97) * 1000000 AS start_us, CAST(floor(o_totalprice) AS BIGINT) * 100 AS end_us, 40000000 AS duration_us FROM orders)"


@register("i11_clip_ranges", f"SELECT o_orderkey, start_us, least(end_us, duration_us) AS clipped_end_us, CASE WHEN start_us >= duration_us THEN 'starts after the media' WHEN least(end_us, duration_us) <= start_us THEN 'empty' END AS problem FROM {_ASK}")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "(o_orderkey % 97) * 1000000 AS start_us", "CAST(floor(o_totalprice) AS BIGINT) * 100 AS end_us", "40000000L AS duration_us")
    return iv.clip_ranges(rows).select("o_orderkey", "start_us", "clipped_end_us", "problem")


@register("i12_clamp_points", duck("SELECT media_id, interval_id, greatest(0, least(duration_us, start_us - 7200000000)) AS first_us, greatest(0, least(duration_us, end_us + 7200000000)) AS last_us FROM truth"))
def _(spark, d):
    rows = standin(spark, d, "truth").withColumn("points", F.array(F.col("start_us") - 2 * HOUR, F.col("end_us") + 2 * HOUR))
    out = iv.clamp_points(rows, "points", "duration_us")
    return out.select("media_id", "interval_id", F.col("points")[0].alias("first_us"), F.col("points")[1].alias("last_us"))


@register("i13_duration_check", duck("SELECT media_id, abs(actual - duration_us) <= 1800000000 AS ok, CASE WHEN abs(actual - duration_us) > 1800000000 THEN 'duration differs by ' || abs(actual - duration_us) || ' us' END AS warning FROM (SELECT media_id, max(duration_us) AS duration_us, max(ts_us) + max(sample_id % 5) * 1000000000 AS actual FROM samples GROUP BY 1)"))
def _(spark, d):
    rows = standin(spark, d, "samples").groupBy("media_id").agg(F.max("duration_us").alias("expected_us"), (F.max("ts_us") + F.max(F.col("sample_id") % 5) * 1_000_000_000).alias("actual_us"))
    return iv.duration_check(rows, tol=HOUR // 2).select("media_id", "ok", "warning")


@register("i14_played_coverage", duck(f"""SELECT m.media_id, m.duration_us, coalesce(c, 0)::BIGINT AS covered_us, coalesce(n, 0)::BIGINT AS n_gaps, (m.duration_us - coalesce(c, 0))::BIGINT AS unplayed_us, m.duration_us - coalesce(c, 0) <= 500000 AS fully_played
  FROM media m LEFT JOIN (SELECT media_id, sum(end_us - start_us) AS c FROM {merged('truth', 1)} GROUP BY 1) x ON m.media_id = x.media_id
  LEFT JOIN (SELECT media_id, count(*) AS n FROM {inverted('truth')} WHERE end_us - start_us > 250000 GROUP BY 1) g ON m.media_id = g.media_id"""))
def _(spark, d):
    return iv.played_coverage(standin(spark, d, "truth").drop("duration_us"), standin(spark, d, "media"))


@register("w01_gap_islands", duck(f"SELECT media_id, sample_id, sum(fresh) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) > {6 * HOUR} THEN 1 ELSE 0 END AS fresh FROM samples)"))
def _(spark, d):
    return tl.gap_islands(standin(spark, d, "samples"), 6 * HOUR, tie=("sample_id",)).select("media_id", "sample_id", "island")


@register("w02_interval_islands", duck(f"SELECT media_id, start_us, end_us FROM {merged('truth')}"))
def _(spark, d):
    return tl.interval_islands(standin(spark, d, "truth")).groupBy("media_id", "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("island")


@register("j03_near_join", duck(f"SELECT p.media_id, p.interval_id, t.interval_id AS r_interval_id FROM predicted p JOIN truth t ON p.media_id = t.media_id WHERE t.start_us <= p.end_us + {HOUR} AND p.start_us <= t.end_us + {HOUR}"))
def _(spark, d):
    return tl.range_join(standin(spark, d, "predicted"), standin(spark, d, "truth"), width=4 * HOUR, tol=HOUR).select("media_id", "interval_id", "r_interval_id")


@register("j04_points_in_intervals", duck(f"SELECT s.media_id, s.sample_id, t.interval_id AS i_interval_id, s.ts_us BETWEEN t.start_us AND t.end_us AS exact FROM samples s JOIN truth t ON s.media_id = t.media_id AND s.ts_us BETWEEN t.start_us - {HOUR} AND t.end_us + {HOUR}"))
def _(spark, d):
    out = tl.points_in_intervals(standin(spark, d, "samples").drop("duration_us"), standin(spark, d, "truth"), width=4 * HOUR, tol=HOUR)
    return out.select("media_id", "sample_id", "i_interval_id", F.col("ts_us").between(F.col("i_start_us"), F.col("i_end_us")).alias("exact"))


@register("j05_overlap_join", duck(f"SELECT p.media_id, p.interval_id, t.interval_id AS r_interval_id, p.start_us <= t.end_us AND t.start_us <= p.end_us AS exact FROM predicted p LEFT JOIN truth t ON p.media_id = t.media_id AND p.start_us - {HOUR} <= t.end_us AND t.start_us <= p.end_us + {HOUR}"))
def _(spark, d):
    out = tl.range_join(standin(spark, d, "predicted"), standin(spark, d, "truth"), width=4 * HOUR, tol=HOUR, unmatched=("media_id", "interval_id"))
    exact = (F.col("start_us") <= F.col("r_end_us")) & (F.col("r_start_us") <= F.col("end_us"))
    return out.select("media_id", "interval_id", "r_interval_id", exact.alias("exact"))


@register("j06_batches_touching", duck("SELECT media_id, interval_id FROM predicted p WHERE EXISTS (SELECT 1 FROM truth t WHERE t.media_id = p.media_id AND t.start_us <= p.end_us AND p.start_us <= t.end_us)"))
def _(spark, d):
    return tl.range_join(standin(spark, d, "predicted"), standin(spark, d, "truth"), width=4 * HOUR).select("media_id", "interval_id").distinct()


@register("j07_missed", duck("""SELECT media_id, interval_id, least(coalesce(start_us - p, 1e18::BIGINT), coalesce(n - end_us, 1e18::BIGINT)) AS distance_us FROM (SELECT t.*, (SELECT max(ts_us) FROM samples s WHERE s.media_id = t.media_id AND event_type = 'purchase' AND ts_us < t.start_us) AS p,
  (SELECT min(ts_us) FROM samples s WHERE s.media_id = t.media_id AND event_type = 'purchase' AND ts_us > t.end_us) AS n FROM truth t WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.media_id = t.media_id AND event_type = 'purchase' AND ts_us BETWEEN t.start_us AND t.end_us)) WHERE p IS NOT NULL OR n IS NOT NULL"""))
def _(spark, d):
    hits = standin(spark, d, "samples").where("event_type = 'purchase'")
    truth = standin(spark, d, "truth")
    held = tl.points_in_intervals(hits.select("media_id", "ts_us"), truth, width=4 * HOUR).select("media_id", F.col("i_interval_id").alias("interval_id"))
    missed = truth.join(held, ["media_id", "interval_id"], "left_anti")
    marks = hits.select("media_id", F.col("ts_us").alias("mark_us"))
    out = tl.as_of(missed, marks, ts="start_us").drop("next_us").withColumnRenamed("prev_us", "before_us")
    out = tl.as_of(out, marks, ts="end_us").drop("prev_us")
    far = F.lit(10**18)
    distance = F.least(F.coalesce(F.col("start_us") - F.col("before_us"), far), F.coalesce(F.col("next_us") - F.col("end_us"), far))
    return out.where("before_us is not null or next_us is not null").select("media_id", "interval_id", distance.alias("distance_us"))


@register("j08_nearest_keyframe", duck(f"""SELECT media_id, sample_id, p AS prev_us, n AS next_us, least(coalesce(ts_us - p, 1e18::BIGINT), coalesce(n - ts_us, 1e18::BIGINT)) <= {HOUR} AS on_mark FROM (SELECT s.media_id, s.sample_id, s.ts_us, (SELECT max(mark_us) FROM marks m WHERE m.media_id = s.media_id AND mark_us <= s.ts_us) AS p,
  (SELECT min(mark_us) FROM marks m WHERE m.media_id = s.media_id AND mark_us >= s.ts_us) AS n FROM samples s)"""))
def _(spark, d):
    return iv.nearest_marks(standin(spark, d, "samples"), standin(spark, d, "marks"), tol=HOUR).select("media_id", "sample_id", "prev_us", "next_us", "on_mark")


@register("j09_cue_at", duck("SELECT s.media_id, s.sample_id, max(t.start_us) AS cue_us FROM samples s JOIN truth t ON s.media_id = t.media_id AND t.start_us = (SELECT max(start_us) FROM truth u WHERE u.media_id = s.media_id AND u.start_us <= s.ts_us) GROUP BY 1, 2 HAVING max(s.ts_us) <= max(t.end_us)"))
def _(spark, d):
    cues = standin(spark, d, "truth").select("media_id", F.col("start_us").alias("mark_us"), F.col("end_us").alias("until"))
    out = tl.as_of(standin(spark, d, "samples"), cues, payload=("until",))
    return out.where("ts_us <= prev_until").select("media_id", "sample_id", F.col("prev_us").alias("cue_us"))
