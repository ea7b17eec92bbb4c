"""Queries that write the tables' data in the sources' forms, or as streams, and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import us_to_timecode
from ..functions.sql import register_functions
from ..operators import planning as pl
from ..shared import scratch as _scratch
from ..shared import stored
from ..sources import readers as rd
from ..sources import sinks
from ..streaming import sinks as st
from ..streaming import streams as sx
from .registry import register
from .sampling_queries import MIN_GAP_SQL, STATIC_SQL
from .standins import HOUR, duck, standin


@register("s01_read_scores", duck("SELECT media_id::VARCHAR AS media_id, sample_id::VARCHAR AS sample_id, ts_us, round(a::DOUBLE, 6) AS nsfw FROM samples"))
def _(spark, d):
    s = standin(spark, d, "samples")
    a = F.round(F.col("a").cast("double"), 6)
    item = F.struct(F.col("sample_id").cast("string").alias("sample_id"), F.col("ts_us").alias("timestamp_us"), F.lit(0.0).alias("nsfl"), a.alias("nsfw"), (1 - a).alias("sfw"), F.lit("sfw").alias("selected_label"), F.array().cast("array<string>").alias("reasons"))
    docs = s.groupBy(F.col("media_id").cast("string").alias("media_id")).agg(F.max("duration_us").alias("duration_us"), F.collect_list(item).alias("samples"))
    docs.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), "media_id", "duration_us", "samples")).alias("value")).write.text(path := _scratch(spark, "scores"))
    return rd.read_scores(spark, path, lines=True).select("media_id", "sample_id", "ts_us", "nsfw")


@register("s04_cuts_round_trip", duck("SELECT media_id::VARCHAR AS filename, (start_us + 500) // 1000 * 1000 AS start_us, (end_us + 500) // 1000 * 1000 AS end_us FROM truth"))
def _(spark, d):
    cuts = standin(spark, d, "truth").select(F.col("media_id").cast("string").alias("filename"), "start_us", "end_us")
    media = standin(spark, d, "media").select(F.col("media_id").cast("string").alias("filename"), "duration_us")
    sinks.write_cuts(cuts, media, path := _scratch(spark, "cuts"))
    return rd.read_cuts(spark, path, lines=True)


@register("s06_read_cues", duck("SELECT media_id, count(*) AS n, min(start_us) AS first_us, max(end_us) AS last_us FROM segments WHERE trim(text) <> '' GROUP BY 1"))
def _(spark, d):
    stamp = lambda c: F.replace(us_to_timecode(F.col(c)), F.lit("."), F.lit(","))
    text = F.when(F.trim("text") != "", F.concat(F.lit("media "), F.col("media_id"), F.lit(": "), F.regexp_replace("text", r"\s+", " ")))
    block = F.concat(F.lit("1\n"), stamp("start_us"), F.lit(" --> "), stamp("end_us"), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
    standin(spark, d, "segments").select(block.alias("value")).write.text(path := _scratch(spark, "cues"))
    media = F.regexp_extract("text", r"^media (\d+): ", 1).cast("bigint").alias("media_id")
    return rd.read_cues(spark, f"{path}/part-*").groupBy(media).agg(F.count("*").alias("n"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))


@register("s07_read_journal", duck("SELECT item_id::VARCHAR AS item_id, config, count(*) AS n FROM attempts WHERE completed GROUP BY 1, 2"))
def _(spark, d):
    a = standin(spark, d, "attempts")
    rows = a.select(F.col("item_id").cast("string").alias("item_id"), "config", F.lit(1).alias("attempt_no"), F.when(F.col("completed"), "done").otherwise("failed").alias("kind"), "at_us")
    rows.write.json(path := _scratch(spark, "journal"))
    return rd.read_journal(spark, path, "done").groupBy("item_id", "config").agg(F.count("*").alias("n"))


@register("s11_read_catalogue", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(p_partkey)::BIGINT AS total FROM part GROUP BY 1")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    paths = {n: _scratch(spark, n) for n in ("train", "test")}
    p.where("p_partkey % 3 > 0").write.option("header", True).csv(paths["train"])
    p.where("p_partkey % 3 = 0").write.option("header", True).csv(paths["test"])
    return rd.read_catalogue(spark, paths, "p_partkey BIGINT").groupBy("split").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total"))


@register("s12_policy_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    sinks.write_policy_table(rows, path := _scratch(spark, "policies"))
    return spark.read.schema("o_orderstatus STRING, n BIGINT").option("header", True).csv(path)


@register("s13_write_once", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    sinks.write_once(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"), path := _scratch(spark, "once"))
    return spark.read.parquet(path)


def _streamed(spark, rows, schema, make, name):
    """Writes rows as JSON files, runs make on the stream of them until all is read, and returns what it wrote."""
    rows.write.json(source := _scratch(spark, f"{name}-in"))
    out, check = _scratch(spark, f"{name}-out"), _scratch(spark, f"{name}-check")
    made = make(sx.stream_samples(spark, source, schema, delay="1 minute", files=10_000))
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


_SAMPLE = "media_id BIGINT, sample_id BIGINT, ts_us BIGINT"


def _plain(spark, d):
    return standin(spark, d, "samples").select("media_id", "sample_id", "ts_us")


_SLOT = f"floor((ts_us - {5 * HOUR}) / {24 * HOUR}.0)"


@register("x01_stream_samples", duck("SELECT media_id, sample_id, ts_us FROM samples"))
def _(spark, d):
    return _streamed(spark, _plain(spark, d), _SAMPLE, lambda s: s.drop("ts"), "samples")


@register("x03_route_phase", duck(f"SELECT media_id, sample_id, ts_us FROM (SELECT *, {_SLOT} AS slot, coalesce(lag({_SLOT}) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id), -1) AS p FROM samples) WHERE slot >= 0 AND slot > p"))
def _(spark, d):
    return _streamed(spark, _plain(spark, d), _SAMPLE, lambda s: sx.route_phase(s, gap=24 * HOUR, phase=5 * HOUR), "phase")


@register("x04_reduce_static", STATIC_SQL)
def _(spark, d):
    rows = standin(spark, d, "samples").select("media_id", "sample_id", "ts_us", F.floor(F.col("ts_us") / (72 * HOUR)).alias("chunk"), "scene", ((F.col("sample_id") % 10) / 9.0).alias("black_fraction"), (F.col("a") * 100).cast("double").alias("mean_luma"), (F.col("sample_id") % 4).cast("bigint").alias("hash"))
    rows = rows.withColumn("region_hashes", F.array(F.when(F.col("sample_id") % 40 == 1, 255).otherwise(F.col("hash")).cast("bigint")))
    schema = f"{_SAMPLE}, chunk BIGINT, scene BOOLEAN, black_fraction DOUBLE, mean_luma DOUBLE, hash BIGINT, region_hashes ARRAY<BIGINT>"
    # as in x09: no row stands at the epoch, where the watermark starts
    out = _streamed(spark, rows.withColumn("ts_us", F.col("ts_us") + 1), schema, lambda s: sx.reduce_static(s, forget="30 days", limit=48 * HOUR, cross=6 * HOUR), "static")
    return out.withColumn("duplicate_of_us", F.col("duplicate_of_us") - 1)


def _weight(b):
    import pyarrow.compute as pc

    return pc.divide(pc.cast(b.column("sample_id"), "double"), 4.0)


@register("x06_micro_batch_score", duck("SELECT media_id, sample_id, sample_id / 4.0::DOUBLE AS probability FROM samples"))
def _(spark, d):
    return _streamed(spark, _plain(spark, d), _SAMPLE, lambda s: pl.score(s.drop("ts"), _weight), "score").select("media_id", "sample_id", "probability")


@register("x09_dedupe_replays", duck("SELECT DISTINCT media_id, sample_id, ts_us FROM samples"))
def _(spark, d):
    # a watermark starts at the epoch, and rows at it are late: the media's clocks start one microsecond behind
    s = _plain(spark, d).withColumn("ts_us", F.col("ts_us") + 1)
    out = _streamed(spark, s.union(s), _SAMPLE, lambda x: sx.dedupe_replays(x).drop("ts"), "replays")
    return out.withColumn("ts_us", F.col("ts_us") - 1)


#: Streams begin so much later than their media, so that no row stands at the epoch, where the watermark starts.
_LATER = 30 * 24 * HOUR


def _slices(spark, rows, n, name, *, order="ts_us", beat=True):
    """Parts rows into n tables, one behind the other in the order of time: as many micro-batches. A row of media -1 far ahead comes
    last, so that the watermark closes all that the others have left open."""
    rows = stored(rows, name)
    edges = rows.approxQuantile(order, [i / n for i in range(1, n)], 0.01)
    part = F.lit(0)
    for e in edges:
        part = part + F.when(F.col(order) > e, 1).otherwise(0)
    parts = [rows.where(part == i) for i in range(n)]
    if beat:
        last = {"media_id": -1, "sample_id": -1, "ts_us": 400 * 24 * HOUR + _LATER}
        parts.append(spark.createDataFrame([tuple(last.values())], "media_id bigint, sample_id bigint, ts_us bigint").coalesce(1))
    return parts


def _in_batches(spark, parts, schema, make, name, mode="append", each=None):
    """Runs make on a stream of parts, each a micro-batch of as many files as its tasks write: the query goes on from its checkpoint
    when the next part's files are there. Returns its batches written by number, or nothing where each (a batch function) takes them."""
    path, out, check = _scratch(spark, name), _scratch(spark, f"{name}-out"), _scratch(spark, f"{name}-check")
    for part in parts:
        part.write.mode("append").json(path)
        made = make(sx.stream_samples(spark, path, schema, delay="1 minute", files=1_000_000))
        made.writeStream.foreachBatch(each or st.table_sink(out)).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return None if each else spark.read.schema(made.schema).option("recursiveFileLookup", True).parquet(out)


def _later(spark, d, *more):
    return standin(spark, d, "samples").select("media_id", "sample_id", (F.col("ts_us") + _LATER).alias("ts_us"), *more)


def _back(df, *columns):
    return df.withColumns({c: F.col(c) - _LATER for c in columns})


@register("x02_chunk_counts", duck(f"SELECT media_id, ts_us // {24 * HOUR} * {24 * HOUR} AS start_us, (ts_us // {24 * HOUR} + 1) * {24 * HOUR} AS end_us, count(*) AS n FROM samples GROUP BY 1, 2, 3"))
def _(spark, d):
    parts = _slices(spark, _later(spark, d), 4, "chunks")
    return _back(_in_batches(spark, parts, _SAMPLE, lambda s: sx.chunk_counts(s, "24 hours"), "chunks"), "start_us", "end_us")


@register("x02_overlapping_chunks", duck(f"SELECT media_id, w * {24 * HOUR} AS start_us, w * {24 * HOUR} + {30 * HOUR} AS end_us, count(*) AS n FROM (SELECT media_id, unnest([ts_us // {24 * HOUR}, (ts_us - {6 * HOUR}) // {24 * HOUR}]) AS w, ts_us FROM samples WHERE (ts_us - {6 * HOUR}) // {24 * HOUR} <> ts_us // {24 * HOUR} AND ts_us >= {6 * HOUR} UNION ALL SELECT media_id, ts_us // {24 * HOUR}, ts_us FROM samples WHERE (ts_us - {6 * HOUR}) // {24 * HOUR} = ts_us // {24 * HOUR} AND ts_us >= {6 * HOUR} UNION ALL SELECT media_id, unnest([-1, 0]), ts_us FROM samples WHERE ts_us < {6 * HOUR}) GROUP BY 1, 2"))
def _(spark, d):
    parts = _slices(spark, _later(spark, d), 4, "overlap")
    return _back(_in_batches(spark, parts, _SAMPLE, lambda s: sx.chunk_counts(s, "24 hours", "30 hours"), "overlap"), "start_us", "end_us")


@register("x05_cluster_sessions", duck(f"SELECT media_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) AS island FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) > {6 * HOUR} THEN 1 ELSE 0 END AS fresh FROM samples)) GROUP BY media_id, island"))
def _(spark, d):
    parts = _slices(spark, _later(spark, d), 4, "sessions")
    return _back(_in_batches(spark, parts, _SAMPLE, lambda s: sx.cluster_sessions(s, "6 hours"), "sessions"), "first_us", "last_us")


# the tracker of positions, report by report
_TRACK = """rp AS (SELECT media_id, ts_us AS wall_us, sample_id AS seq, CASE event_type WHEN 'error' THEN 'interrupt' WHEN 'signup' THEN 'resume' ELSE 'observe' END AS kind, ts_us // 2 + (sample_id % 3) * 1000000 AS position_us, CASE WHEN sample_id % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS rate,
  row_number() OVER (PARTITION BY media_id ORDER BY ts_us, sample_id) AS n FROM samples),
tk AS (WITH RECURSIVE t AS (SELECT media_id, n, CASE WHEN kind = 'observe' THEN position_us END AS a, CASE WHEN kind = 'observe' THEN wall_us END AS w, CASE WHEN kind = 'observe' THEN rate END AS r, NULL::BIGINT AS s, NULL::BIGINT AS e FROM rp WHERE n = 1
  UNION ALL SELECT p.media_id, p.n, CASE kind WHEN 'observe' THEN position_us WHEN 'resume' THEN t.a END, CASE WHEN kind = 'observe' OR (kind = 'resume' AND t.a IS NOT NULL) THEN wall_us END, CASE kind WHEN 'observe' THEN rate WHEN 'resume' THEN t.r END,
    CASE WHEN kind = 'observe' AND rate = t.r AND position_us > t.a AND position_us - t.a <= t.r * (wall_us - t.w) + 250000 THEN t.a END, CASE WHEN kind = 'observe' AND rate = t.r AND position_us > t.a AND position_us - t.a <= t.r * (wall_us - t.w) + 250000 THEN position_us END
  FROM t JOIN rp p ON p.media_id = t.media_id AND p.n = t.n + 1) SELECT * FROM t)"""
_PLAYED = duck("SELECT media_id, s AS start_us, e AS end_us FROM tk WHERE s IS NOT NULL", _TRACK)


def _reports(spark, d, later=0):
    kind = F.when(F.col("event_type") == "error", "interrupt").when(F.col("event_type") == "signup", "resume").otherwise("observe")
    rate = F.when(F.col("sample_id") % 5 == 0, 1.0).otherwise(0.5)
    return standin(spark, d, "samples").select("media_id", (F.col("ts_us") + later).alias("wall_us"), F.col("sample_id").alias("seq"), kind.alias("kind"), F.expr("ts_us div 2 + (sample_id % 3) * 1000000").alias("position_us"), rate.alias("rate"))


@register("x08_played_ranges", _PLAYED)
def _(spark, d):
    return sx.played_ranges(_reports(spark, d))


@register("x08_track_played", _PLAYED)
def _(spark, d):
    rows = _reports(spark, d, _LATER).withColumn("ts_us", F.col("wall_us"))
    parts = _slices(spark, rows, 4, "played", beat=False)
    schema = "media_id BIGINT, wall_us BIGINT, seq BIGINT, kind STRING, position_us BIGINT, rate DOUBLE, ts_us BIGINT"
    return _in_batches(spark, parts, schema, lambda s: sx.track_played(s, forget="400 days"), "played")


@register("x10_progress_monitor", duck("SELECT media_id AS run_id, event_type AS stage, arg_max(ts_us, sample_id) AS done, max(duration_us) AS total, count(*) FILTER (scene) AS n_failed FROM samples GROUP BY 1, 2"))
def _(spark, d):
    columns = (F.col("media_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("ts_us").alias("done"), F.col("duration_us").alias("total"), F.col("sample_id").alias("seq"), F.col("scene").alias("failed"))
    parts = _slices(spark, standin(spark, d, "samples").select(*columns, "ts_us"), 4, "progress", order="seq", beat=False)
    schema = "run_id BIGINT, stage STRING, done BIGINT, total BIGINT, seq BIGINT, failed BOOLEAN, ts_us BIGINT"
    out = _scratch(spark, "progress-table")
    _in_batches(spark, parts, schema, sx.progress_monitor, "progress", mode="update", each=st.table_sink(out))
    return st.read_latest(spark, out, "run_id BIGINT, stage STRING, done BIGINT, total BIGINT, n_failed BIGINT", ["run_id", "stage"])


@register("x11_routing_metrics", duck("SELECT media_id, count(*) AS n_observed, count(*) FILTER (scene) AS n_routed, CASE WHEN count(*) FILTER (scene) > 0 THEN sha256(array_to_string(list(ts_us ORDER BY ts_us) FILTER (scene), chr(10))) END AS digest, count(*) - count(*) FILTER (scene) AS n_skipped FROM samples GROUP BY 1"))
def _(spark, d):
    s = standin(spark, d, "samples")
    return sx.routing_metrics(s, s.where("scene"))


@register("x11_routing_windows", duck(f"SELECT media_id, ts_us // {72 * HOUR} * {72 * HOUR} AS start_us, count(*) AS n_observed, count(*) FILTER (scene) AS n_routed, CASE WHEN count(*) FILTER (scene) > 0 THEN sha256(array_to_string(list(ts_us + {_LATER} ORDER BY ts_us) FILTER (scene), chr(10))) END AS digest, count(*) - count(*) FILTER (scene) AS n_skipped FROM samples GROUP BY 1, 2"))
def _(spark, d):
    parts = _slices(spark, _later(spark, d, "scene"), 4, "routing")
    return _back(_in_batches(spark, parts, f"{_SAMPLE}, scene BOOLEAN", lambda s: sx.routing_windows(s, "72 hours", F.coalesce(F.col("scene"), F.lit(False))), "routing"), "start_us")


_LATE_PART = "(sample_id * 2654435761) % 97 % 5"


@register("x12_late_audit", duck(f"SELECT p.media_id, p.sample_id, p.ts_us, p.ts_us <= m.most - {48 * HOUR} AS late FROM (SELECT *, {_LATE_PART} AS part FROM samples) p LEFT JOIN (SELECT a.part, max(b.ts_us) AS most FROM (SELECT unnest(range(5)) AS part) a JOIN (SELECT ts_us, {_LATE_PART} AS part FROM samples) b ON b.part < a.part GROUP BY 1) m ON m.part = p.part WHERE m.most IS NOT NULL UNION ALL SELECT media_id, sample_id, ts_us, false FROM samples WHERE {_LATE_PART} = 0"))
def _(spark, d):
    rows = stored(_plain(spark, d), "late")
    parts = [rows.where(F.expr(_LATE_PART) == i) for i in range(5)]
    good, dead = _scratch(spark, "on-time"), _scratch(spark, "dead-letters")
    _in_batches(spark, parts, _SAMPLE, lambda s: s.drop("ts"), "late", each=st.late_audit(st.table_sink(good), st.table_sink(dead), _scratch(spark, "marks"), delay_us=48 * HOUR))
    read = lambda p, late: st.read_sink(spark, p, _SAMPLE).select("media_id", "sample_id", "ts_us", F.lit(late).alias("late"))
    return read(good, False).union(read(dead, True))


@register("x07_fan_out", duck("SELECT 'all' AS sink, media_id, sample_id FROM samples UNION ALL SELECT 'scenes', media_id, sample_id FROM samples WHERE scene"))
def _(spark, d):
    """Two sinks and one that is always down; the sink of scenes fails at its first try of every batch, after it has written."""
    parts = _slices(spark, _later(spark, d, "scene"), 3, "fan", beat=False)
    tables = {n: _scratch(spark, n) for n in ("all", "scenes")}
    tried: set[int] = set()

    def shaky(batch, number):
        st.table_sink(tables["scenes"])(batch.where("scene"), number)
        if number not in tried:
            tried.add(number)
            raise OSError("lost on the way back")

    def down(batch, number):
        raise OSError("down")

    each = st.fan_out({"down": down, "all": st.table_sink(tables["all"]), "scenes": shaky}, _scratch(spark, "ledger"), attempts=2)
    _in_batches(spark, parts, f"{_SAMPLE}, scene BOOLEAN", lambda s: s.drop("ts"), "fan", each=each)
    read = lambda n: st.read_sink(spark, tables[n], f"{_SAMPLE}, scene BOOLEAN").select(F.lit(n).alias("sink"), "media_id", "sample_id")
    return read("all").union(read("scenes"))


@register("d06_sql_functions", duck("SELECT p.media_id, p.interval_id, t.interval_id AS r_interval_id, greatest(0, least(p.end_us, t.end_us) - greatest(p.start_us, t.start_us)) AS both_us FROM predicted p JOIN truth t ON p.media_id = t.media_id AND p.category = t.category AND p.start_us <= t.end_us AND t.start_us <= p.end_us"))
def _(spark, d):
    register_functions(spark)
    p = standin(spark, d, "predicted").select("media_id", "interval_id", "start_us", "end_us", "category")
    t = standin(spark, d, "truth").select("media_id", "interval_id", "start_us", "end_us", "category")
    return spark.sql("SELECT p.media_id, p.interval_id, t.interval_id AS r_interval_id, overlap_us(p.start_us, p.end_us, t.start_us, t.end_us) AS both_us FROM {p} p JOIN {t} t ON p.media_id = t.media_id AND p.category = t.category AND p.start_us <= t.end_us AND t.start_us <= p.end_us", p=p, t=t)


@register("d05_table_functions", duck(f"SELECT media_id, count(*) AS n, max(e) AS end_us FROM (SELECT media_id, least(duration_us, (c + 1) * {72 * HOUR}) AS e FROM (SELECT *, unnest(range(greatest(1, ceil(duration_us / {72 * HOUR})::BIGINT))) AS c FROM media)) GROUP BY 1"))
def _(spark, d):
    register_functions(spark)
    m = standin(spark, d, "media")
    return spark.sql(f"SELECT media_id, count(*) AS n, max(core_end_us) AS end_us FROM {{m}} m, LATERAL plan_chunks(m.duration_us, {72 * HOUR}L) GROUP BY media_id", m=m)


@register("d05_phase_grid", duck(f"SELECT media_id, phase FROM media, (SELECT unnest([0, 2700000000, 3600000000, 5400000000, 7200000000, 8100000000]) AS phase)"))
def _(spark, d):
    register_functions(spark)
    return spark.sql(f"SELECT media_id, phase FROM {{m}} m, LATERAL phase_grid({3 * HOUR}L, {HOUR}L)", m=standin(spark, d, "media"))


@register("d05_min_gap", MIN_GAP_SQL)
def _(spark, d):
    register_functions(spark)
    standin(spark, d, "samples").createOrReplaceTempView("spanframe_samples")
    return spark.sql(f"SELECT media_id, ts_us FROM min_gap(TABLE(spanframe_samples), 'media_id', 'ts_us', {24 * HOUR}L)")


@register("d05_threshold_grid", duck("SELECT DISTINCT media_id, v[r + 1] AS threshold FROM (SELECT media_id, v, unnest(list_transform(range(5), lambda i: round_even(i * (len(v) - 1) / 4.0, 0)::BIGINT)) AS r FROM (SELECT media_id, list(a::DOUBLE ORDER BY a) AS v FROM samples GROUP BY 1))"))
def _(spark, d):
    register_functions(spark)
    standin(spark, d, "samples").select("media_id", F.col("a").cast("double").alias("a")).createOrReplaceTempView("spanframe_scores")
    return spark.sql("SELECT * FROM threshold_grid(TABLE(spanframe_scores), 'media_id', 'a', 5)")


@register("s02_read_ground_truth", duck("SELECT media_id::VARCHAR AS media_id, interval_index, start_us, end_us, category, CASE WHEN bad = 0 THEN 'reversed' WHEN bad = 1 THEN 'not a timecode' END AS problem FROM (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_us, interval_id) - 1 AS interval_index, CASE WHEN interval_id % 11 = 1 THEN NULL WHEN interval_id % 11 = 0 THEN end_us // 1000 * 1000 ELSE start_us // 1000 * 1000 END AS start_us, CASE WHEN interval_id % 11 = 0 THEN start_us // 1000 * 1000 ELSE end_us // 1000 * 1000 END AS end_us, category, interval_id % 11 AS bad FROM truth)"))
def _(spark, d):
    t, n = standin(spark, d, "truth"), F.col("interval_id")
    start, end = (us_to_timecode(F.expr(f"{c} div 1000 * 1000")) for c in ("start_us", "end_us"))
    cut = F.struct(F.col("start_us").alias("o"), n.alias("n"), F.when(n % 11 == 0, end).when(n % 11 == 1, F.lit("soon")).otherwise(start).alias("start"), F.when(n % 11 == 0, start).otherwise(end).alias("end"), "category")
    rows = t.groupBy(F.col("media_id").cast("string").alias("media_id")).agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.max("duration_us").alias("x"))
    cuts = F.transform("cuts", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["category"].alias("category")))
    rows.select(F.to_json(F.struct("media_id", us_to_timecode(F.col("x")).alias("duration"), cuts.alias("cuts"))).alias("value")).write.text(path := _scratch(spark, "truth"))
    return rd.read_ground_truth(spark, path, lines=True).select("media_id", "interval_index", "start_us", "end_us", "category", "problem")


@register("s03_read_semantic_scores", duck("SELECT media_id::VARCHAR AS media_id, sample_id::VARCHAR AS sample_id, ts_us, k AS concept_id, round(CASE k WHEN 'x' THEN a ELSE b END::DOUBLE, 6) AS cosine FROM samples, (SELECT unnest(['x', 'y']) AS k)"))
def _(spark, d):
    one = lambda k, c: F.struct(F.lit(k).alias("concept_id"), F.round(F.col(c).cast("double"), 6).alias("cosine"), F.lit(1.0).alias("logit"))
    item = F.struct(F.col("sample_id").cast("string").alias("sample_id"), F.col("ts_us").alias("timestamp_us"), F.array(one("x", "a"), one("y", "b")).alias("scores"))
    rows = standin(spark, d, "samples").groupBy(F.col("media_id").cast("string").alias("media_id")).agg(F.collect_list(item).alias("samples"))
    rows.select(F.to_json(F.struct("media_id", F.lit("d").alias("bank_digest"), "samples")).alias("value")).write.text(path := _scratch(spark, "semantic"))
    return rd.read_semantic_scores(spark, path, lines=True).select("media_id", "sample_id", "ts_us", "concept_id", "cosine")


@register("s05_read_packets", duck("SELECT decode_pos % 1000 AS pos, count(*) AS n, sum(pts_us)::BIGINT AS total_us, count(*) FILTER (is_key) AS n_keys, min(data_hash) AS least FROM packets WHERE media_id = 1 GROUP BY 1"))
def _(spark, d):
    p = standin(spark, d, "packets").where("media_id = 1").withColumn("pts_us", F.col("pts_us") + 1_000_000)
    line = F.concat_ws(",", F.format_string("%d.%06d", F.expr("pts_us div 1000000"), F.expr("pts_us % 1000000")), F.when(F.col("is_key"), "K__").otherwise("___"), "data_hash")
    p.orderBy("decode_pos").select(line.alias("value")).coalesce(1).write.text(path := _scratch(spark, "packets"))
    rows = rd.read_packets(spark, f"{path}/part-*", "m")
    return rows.groupBy((F.col("decode_pos") % 1000).alias("pos")).agg(F.count("*").alias("n"), F.sum("pts_us").alias("total_us"), F.count_if("is_key").alias("n_keys"), F.min("data_hash").alias("least"))


@register("s09_discover_media", "SELECT lang || '-' || least(doc_id % 50, 49) AS stem, 'mp4' AS extension, count(*) FILTER (doc_id % 3 = 0) > 0 AS has_sidecar FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("lang is not null").select(F.concat_ws("-", "lang", (F.col("doc_id") % 50).cast("string")).alias("stem"), (F.col("doc_id") % 3 == 0).alias("sub"))
    path, stems = _scratch(spark, "folder"), docs.groupBy("stem").agg(F.bool_or("sub").alias("sub"))
    stems.select(F.lit("x").alias("value"), F.col("stem").alias("name")).write.partitionBy("name").text(f"{path}/media")
    stems.where("sub").select(F.lit("x").alias("value"), F.col("stem").alias("name")).write.partitionBy("name").text(f"{path}/sub")
    files = rd.discover_files(spark, path, ("txt",))
    # a writer names its files itself: the folder's name stands for the stem
    named = files.select(F.regexp_extract("path", "/name=([^/]+)/", 1).alias("stem"), F.when(F.col("path").contains("/sub/"), "srt").otherwise("mp4").alias("extension"), "path")
    media = named.where("extension = 'mp4'").dropDuplicates(["stem"])
    pairs = rd.match_sidecars(media, named.where("extension = 'srt'"))
    return media.join(pairs.select("path", F.lit(True).alias("has_sidecar")).distinct(), "path", "left").select("stem", "extension", F.coalesce("has_sidecar", F.lit(False)).alias("has_sidecar"))


@register("s10_read_frame_annotations", "SELECT l_orderkey::VARCHAR AS item_id, CASE WHEN l_linenumber % 2 = 0 THEN 'age' ELSE 'gender' END AS attribute, l_linenumber * 10 AS first_frame, l_linenumber * 10 + l_quantity::INT AS last_frame, array_to_string([l_suppkey % 3, l_partkey % 3], ',') AS vals FROM lineitem WHERE l_orderkey % 4 = 0")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 4 = 0")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "age").otherwise("gender")
    one = F.struct((F.col("l_linenumber") * 10).cast("int").alias("first"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).cast("int").alias("last"), F.array((F.col("l_suppkey") % 3).cast("int"), (F.col("l_partkey") % 3).cast("int")).alias("values"))
    per = rows.groupBy(F.col("l_orderkey").cast("string").alias("item"), kind.alias("kind")).agg(F.collect_list(one).alias("x")).groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("kind", "x"))).alias("a"))
    per.groupBy((F.xxhash64("item") % 50).alias("f")).agg(F.map_from_entries(F.collect_list(F.struct("item", "a"))).alias("m")).select(F.to_json("m").alias("value")).write.text(path := _scratch(spark, "annotations"))
    return rd.read_frame_annotations(spark, path, lines=True).select("item_id", "attribute", "first_frame", "last_frame", F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"))


@register("s17_fingerprint_files", "SELECT page_id, sha256(html || chr(10)) AS sha256, strlen(html) + 1 AS length FROM pages WHERE page_id % 5 = 0 AND html NOT LIKE '%' || chr(10) || '%'")
def _(spark, d):
    """Pages as files: the longer ones are read piece by piece."""
    p = spark.read.parquet(f"{d}/pages.parquet").where("page_id % 5 = 0").where(~F.col("html").contains("\n"))
    p.select(F.col("html").alias("value"), "page_id").repartition("page_id").write.partitionBy("page_id").text(path := _scratch(spark, "files"))
    found = rd.fingerprint_files(spark, path, whole=5000, piece=777).where(F.col("path").contains("/page_id="))
    return found.select(F.regexp_extract("path", "/page_id=([0-9]+)/", 1).cast("bigint").alias("page_id"), "sha256", "length")
