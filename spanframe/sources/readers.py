"""Sources: versioned JSON artifacts, cut lists, packets, subtitles, journals, probes, media folders, annotations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_cue, parse_fraction, timecode_to_us

#: The fields of score artifacts, and the extensions of media and subtitle files.
SAMPLE = "sample_id STRING, timestamp_us BIGINT, nsfl DOUBLE, nsfw DOUBLE, sfw DOUBLE, selected_label STRING, reasons ARRAY<STRING>"
SCORES = f"schema_version INT, media_id STRING, duration_us BIGINT, samples ARRAY<STRUCT<{SAMPLE.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT').replace(' DOUBLE', ': DOUBLE').replace(' ARRAY<STRING>', ': ARRAY<STRING>')}>>"
MEDIA = ("mp4", "mkv", "mov", "avi", "webm")
SIDECARS = ("srt", "ass", "vtt")


def _json(spark: SparkSession, path: str, schema: str, mode: str, whole: bool = True) -> DataFrame:
    if mode == "FAILFAST":
        return spark.read.schema(schema).option("multiLine", whole).option("mode", mode).json(path)
    return spark.read.schema(f"{schema}, _corrupt_record STRING").option("multiLine", whole).option("mode", mode).json(path)


def read_scores(spark: SparkSession, path: str, *, mode: str = "FAILFAST", lines: bool = False) -> DataFrame:
    """Score artifacts -> a row a sample: media_id, duration_us, sample_id, ts_us, the three probabilities, label, reasons.
    Malformed files fail, or with PERMISSIVE give a row with _corrupt_record. lines: one artifact a line, so files split."""
    rows = _json(spark, path, SCORES, mode, not lines)
    extra = [c for c in rows.columns if c == "_corrupt_record"]
    rows = rows.select("media_id", "duration_us", *extra, F.explode_outer("samples").alias("s"))
    return rows.select("media_id", "duration_us", *extra, "s.sample_id", F.col("s.timestamp_us").alias("ts_us"), "s.nsfl", "s.nsfw", "s.sfw", "s.selected_label", "s.reasons")


def read_ground_truth(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Truth files of two layouts (intervals or cuts; timecodes) -> rows with start_us, end_us, category, severity and
    problem for rows that are reversed or leave the media. lines: one file's object a line."""
    item = "STRUCT<start: STRING, end: STRING, category: STRING, severity: STRING, notes: STRING>"
    rows = spark.read.schema(f"media_id STRING, duration STRING, intervals ARRAY<{item}>, cuts ARRAY<{item}>").option("multiLine", not lines).json(path)
    rows = rows.select("media_id", timecode_to_us(F.col("duration")).alias("duration_us"), F.posexplode(F.coalesce("intervals", "cuts")).alias("interval_index", "i"))
    out = rows.select("media_id", "duration_us", "interval_index", timecode_to_us(F.col("i.start")).alias("start_us"), timecode_to_us(F.col("i.end")).alias("end_us"), "i.category", "i.severity", "i.notes")
    problem = F.when(F.col("start_us").isNull() | F.col("end_us").isNull(), "not a timecode").when(F.col("end_us") <= F.col("start_us"), "reversed").when(F.col("end_us") > F.col("duration_us"), "outside the media")
    return out.withColumn("problem", problem)


def read_semantic_scores(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Nested concept scores -> a row a sample and concept, with the digest of the prompt bank they were made with. lines: one
    artifact a line."""
    score = "STRUCT<concept_id: STRING, cosine: DOUBLE, logit: DOUBLE>"
    schema = f"media_id STRING, bank_digest STRING, samples ARRAY<STRUCT<sample_id: STRING, timestamp_us: BIGINT, scores: ARRAY<{score}>>>"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path).select("media_id", "bank_digest", F.explode("samples").alias("s"))
    rows = rows.select("media_id", "bank_digest", "s.sample_id", F.col("s.timestamp_us").alias("ts_us"), F.explode("s.scores").alias("c"))
    return rows.select("media_id", "bank_digest", "sample_id", "ts_us", "c.concept_id", "c.cosine", "c.logit")


def read_prompt_bank(spark: SparkSession, path: str) -> DataFrame:
    """concept_id, prompt vector and digest (SHA-256 of the canonical JSON of the prompts in order)."""
    rows = spark.read.schema("prompts ARRAY<STRUCT<concept_id: STRING, prompt: ARRAY<DOUBLE>>>").option("multiLine", True).json(path)
    rows = rows.withColumn("bank_digest", F.sha2(F.to_json("prompts"), 256)).select("bank_digest", F.explode("prompts").alias("p"))
    return rows.select("bank_digest", "p.concept_id", "p.prompt")


def read_cuts(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Cut lists -> filename, start_us, end_us; seconds or timecodes, under any of the known keys."""
    keys = "start STRING, end STRING, requested_start_seconds STRING, requested_end_seconds STRING"
    item = "STRUCT<" + keys.replace(" STRING", ": STRING") + ">"
    rows = spark.read.schema(f"version INT, video STRUCT<filename: STRING, duration: DOUBLE>, cuts ARRAY<{item}>").option("multiLine", not lines).json(path)
    rows = rows.select(F.col("video.filename").alias("filename"), F.explode("cuts").alias("c"))

    def us(*names: str) -> Column:
        text = F.coalesce(*[F.col(f"c.{n}") for n in names])
        return F.coalesce(F.round(text.try_cast("decimal(20,6)") * 1_000_000).cast("bigint"), timecode_to_us(text))

    return rows.select("filename", us("start", "requested_start_seconds").alias("start_us"), us("end", "requested_end_seconds").alias("end_us")).orderBy("filename", "start_us")


def read_packets(spark: SparkSession, path: str, media: str) -> DataFrame:
    """Packet lines (pts_time,flags,data_hash) in decode order -> decode_pos, pts_us from the first pts, is_key, data_hash."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("decode_pos", "line")).where("trim(line) <> ''")
    p = F.split("line", ",")
    rows = lines.select(F.lit(media).alias("media_id"), F.col("decode_pos").cast("bigint").alias("decode_pos"), F.round(p[0].try_cast("decimal(20,9)") * 1_000_000).cast("bigint").alias("__pts"), F.contains(p[1], F.lit("K")).alias("is_key"), F.get(p, 2).alias("data_hash"))
    checked = F.coalesce("__pts", F.raise_error(F.lit("a packet has no pts")).cast("bigint"))
    first = rows.agg(F.min("__pts").alias("__first"))
    return rows.join(F.broadcast(first)).withColumn("pts_us", checked - F.col("__first")).drop("__pts", "__first")


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files (SRT) -> path, start_us, end_us, text; empty and reversed cues are dropped."""
    blocks = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.explode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n\s*\n")).alias("b"))
    stamp = r"(\d+:\d+:\d+[,.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+)[^\n]*\n?((?s).*)"
    at = lambda i: timecode_to_us(F.replace(F.regexp_extract("b", stamp, i), F.lit(","), F.lit(".")))
    rows = blocks.select("path", at(1).alias("start_us"), at(2).alias("end_us"), clean_cue(F.regexp_replace(F.regexp_extract("b", stamp, 3), r"\s+$", "")).alias("text"))
    return rows.where("end_us > start_us and text <> ''").orderBy("path", "start_us")


def read_journal(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """JSONL attempt journals: item_id, config, attempt_no, kind, at_us, payload (JSON text)."""
    rows = spark.read.schema("item_id STRING, config STRING, attempt_no INT, kind STRING, at_us BIGINT, payload STRING").json(path)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def media_probe(df: DataFrame, probe: str = "probe") -> DataFrame:
    """Probe JSON in a column -> duration_us, width, height, fps, has_audio, n_streams of the first video stream."""
    stream = "STRUCT<codec_type: STRING, width: INT, height: INT, avg_frame_rate: STRING, duration: STRING>"
    x = df.withColumn("__p", F.from_json(probe, f"format STRUCT<duration: STRING>, streams ARRAY<{stream}>"))
    of = lambda kind: F.filter("__p.streams", lambda s: s["codec_type"] == kind)
    video = F.get(of("video"), 0)
    seconds = F.coalesce(F.col("__p.format.duration").try_cast("decimal(20,6)"), video["duration"].try_cast("decimal(20,6)"))
    return x.withColumns({"duration_us": (seconds * 1_000_000).cast("bigint"), "width": video["width"], "height": video["height"], "fps": parse_fraction(video["avg_frame_rate"]), "has_audio": F.size(of("audio")) > 0, "n_streams": F.size("__p.streams")}).drop("__p")


def discover_files(spark: SparkSession, path: str, extensions: Sequence[str] = MEDIA) -> DataFrame:
    """Files below path with one of the extensions: path, stem (lower case), extension, length. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = files.withColumns({"stem": F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "extension": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})
    return out.where(F.col("extension").isin(list(extensions)))


def match_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars of a media file: the same stem, or the stem, a separator and a short tag of letters."""
    s = sidecars.select(F.col("path").alias("sidecar"), F.regexp_replace("stem", r"[._ -][a-z]{2,8}$", "").alias("base"), F.col("stem").alias("whole"))
    both = s.select("sidecar", F.explode(F.array_distinct(F.array("base", "whole"))).alias("stem"))
    return media.join(both, "stem").select("path", "sidecar").distinct()


def fingerprint_files(spark: SparkSession, path: str, *, whole: int = 64 << 20, piece: int = 8 << 20) -> DataFrame:
    """(path, length, sha256) of all files below path.

    Files of up to whole bytes are read by Spark; larger ones by their path on an executor, piece bytes at a time, so that no row
    holds a file and no length is too great. Spark's file sources pass over empty files, and so does this. Executors must see the path by the file systems of Arrow (local, NFS, HDFS, S3 ..)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = found.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            digests = []
            for uri in b.column(0).to_pylist():
                local = re.match("file:/+", uri)
                system, where = (fs.LocalFileSystem(), f"/{uri[local.end():]}") if local else fs.FileSystem.from_uri(quote(uri, safe="/:@"))
                digest = hashlib.sha256()
                with system.open_input_stream(where) as stream:
                    while data := stream.read(piece):
                        digest.update(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], names=["path", "length", "sha256"])

    large = found.where(F.col("length") > whole).select("path", "length").repartition("path")
    return small.unionByName(large.mapInArrow(run, "path string, length bigint, sha256 string"))


def read_frame_annotations(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Per-video attribute segments {video: {attribute: [{first, last, values}]}} -> rows of inclusive frame ranges. lines: one
    such object a line."""
    segment = "STRUCT<first: INT, last: INT, values: ARRAY<INT>>"
    rows = spark.read.text(path, wholetext=not lines).select(F.from_json("value", f"MAP<STRING, MAP<STRING, ARRAY<{segment}>>>").alias("m"))
    rows = rows.select(F.explode("m").alias("item_id", "a")).select("item_id", F.explode("a").alias("attribute", "s")).select("item_id", "attribute", F.explode("s").alias("x"))
    return rows.select("item_id", "attribute", F.col("x.first").alias("first_frame"), F.col("x.last").alias("last_frame"), F.col("x.values").alias("values"))


def read_catalogue(spark: SparkSession, splits: dict[str, str], schema: str) -> DataFrame:
    """CSV files of several splits as one table with a split column."""
    out = None
    for name, path in sorted(splits.items()):
        rows = spark.read.schema(schema).option("header", True).csv(path).withColumn("split", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
