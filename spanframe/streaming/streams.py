"""Structured Streaming twins of the ordered operators; each equals its batch form on complete input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sampling import FRAME, frame_evidence, static_step

KEY = "media_id"


def stream_samples(spark: SparkSession, path: str, schema: str, *, delay: str = "10 minutes", files: int = 10) -> DataFrame:
    """Samples from a folder of JSON files; ts (timestamp) from ts_us, with a watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    return rows.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)


def chunk_counts(samples: DataFrame, core: str, overlap: str | None = None) -> DataFrame:
    """Samples of each tumbling core; with overlap (the core plus its context) a sliding window every core."""
    window = F.window("ts", core) if overlap is None else F.window("ts", overlap, core)
    return samples.groupBy(KEY, window.alias("w")).agg(F.count("*").alias("n")).select(KEY, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def cluster_sessions(samples: DataFrame, gap: str) -> DataFrame:
    """Events of points at most gap apart."""
    w = F.session_window("ts", gap).alias("w")
    return samples.groupBy(KEY, w).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")).drop("w")


def dedupe_replays(samples: DataFrame) -> DataFrame:
    return samples.dropDuplicatesWithinWatermark([KEY, "sample_id"])


def _stateful(samples: DataFrame, step: Callable[[list, tuple], tuple[list, tuple | None]], init: list, output: str, state: str) -> DataFrame:
    """Feeds each key's rows in order of (ts_us, sample_id) to step(state, (ts_us, sample_id)); step gives the new state
    and a row or None. Rows of one batch are sorted; a batch never reaches back behind the one before."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = list(held.get) if held.exists else list(init)
        rows = pd.concat(list(parts)).sort_values(["ts_us", "sample_id"])
        out = []
        for row in zip(rows["ts_us"].tolist(), rows["sample_id"].tolist(), strict=True):
            now, made = step(now, row)
            if made is not None:
                out.append((key[0], *made))
        held.update(tuple(now))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in output.split(", ")])

    return samples.groupBy(KEY).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def route_phase(samples: DataFrame, *, gap: int, phase: int = 0) -> DataFrame:
    """The first sample at or after each phase + k * gap, online; late rows behind the last slot are not routed."""

    def step(s: list, row: tuple) -> tuple[list, tuple | None]:
        slot = (row[0] - phase) // gap
        return ([slot], row) if slot >= 0 and slot > s[0] else (s, None)

    return _stateful(samples, step, [-1], f"{KEY} bigint, ts_us bigint, sample_id bigint", "slot bigint")


def route_min_gap(samples: DataFrame, *, gap: int) -> DataFrame:
    """The first sample, then each first one at least gap after the last routed."""

    def step(s: list, row: tuple) -> tuple[list, tuple | None]:
        return ([row[0], 1], row) if not s[1] or row[0] - s[0] >= gap else (s, None)

    return _stateful(samples, step, [0, 0], f"{KEY} bigint, ts_us bigint, sample_id bigint", "last bigint, some bigint")


def reduce_static(frames: DataFrame, *, forget: str = "1 hour", bits: int = 3, colour: float = 12.0, limit: int = 10_000_000, cross: int = 50_000, black: float = 0.98, black_luma: float = 255.0) -> DataFrame:
    """The online form of sampling.reduce_static, with the same evidence and rule; the state is the last representative.

    A batch's rows are taken in order; rows behind the last row of their media (late ones) are dispositioned "late" and change
    nothing, and Spark drops those behind the watermark of ts. The state of a media is dropped once the watermark is past its
    last row by the time forget."""
    output = f"{KEY} bigint, sample_id bigint, disposition string, duplicate_of_us bigint"
    silence = int(pd.Timedelta(forget).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        seen, *old = tuple(held.get) if held.exists else (None,) * 5
        last = None if old[0] is None else tuple(old)
        rows = pd.concat(list(parts)).sort_values(["ts_us", "sample_id"])
        out = []
        plain = lambda c: [x.tolist() for x in rows[c]] if c.startswith("__") else rows[c].tolist()
        for row in zip(*map(plain, FRAME), strict=True):
            if seen is not None and row[0] < seen:
                out.append((key[0], row[1], "late", None))
                continue
            seen = row[0]
            last, what, of = static_step(last, row, bits=bits, colour=colour, limit=limit, cross=cross, black=black, black_luma=black_luma)
            out.append((key[0], row[1], what, of))
        held.update((seen, *((None,) * 4 if last is None else (last[0], last[1], [int(x) for x in last[2]], [float(x) for x in last[3]]))))
        held.setTimeoutTimestamp(max(seen // 1000, held.getCurrentWatermarkMs()) + silence)
        yield pd.DataFrame(out, columns=[KEY, "sample_id", "disposition", "duplicate_of_us"]).astype({"duplicate_of_us": "Int64"})

    rows = frame_evidence(frames).select(KEY, "ts", *FRAME)
    return rows.groupBy(KEY).applyInPandasWithState(run, output, "seen bigint, t bigint, chunk bigint, hashes array<bigint>, colours array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def played_ranges(reports: DataFrame, *, slack: int = 250_000) -> DataFrame:
    """(media_id, start_us, end_us): steps between neighbouring position reports that play explains.

    reports(media_id, wall_us, seq, kind, position_us, rate), in the order of wall_us, then seq. An observe whose rate is that of
    the observe before counts the step between them if it is forward, and at most rate * elapsed + slack; an interrupt
    between them forbids it, and a resume starts the elapsed time anew. Other columns of an interrupt or resume are not read.
    Batch form; track_played is the online one. Replays give ranges of their own: merge_intervals counts them once.
    """
    order = ("wall_us", "seq")
    parts = F.sum(F.when(F.col("kind") == "interrupt", 1).otherwise(0)).over(Window.partitionBy(KEY).orderBy(*order))
    rows = reports.withColumn("__part", parts).where("kind <> 'interrupt'")
    w = Window.partitionBy(KEY, "__part").orderBy(*order)
    seen = F.when(F.col("kind") == "observe", F.struct("position_us", "rate"))
    rows = rows.withColumn("__last", F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__wall", F.lag("wall_us").over(w))
    step, elapsed = F.col("position_us") - F.col("__last.position_us"), F.col("wall_us") - F.col("__wall")
    counts = (F.col("kind") == "observe") & (F.col("rate") == F.col("__last.rate")) & (step > 0) & (step <= F.col("__last.rate") * elapsed + slack)
    return rows.where(counts).select(KEY, F.col("__last.position_us").alias("start_us"), F.col("position_us").alias("end_us"))


def track_played(reports: DataFrame, *, slack: int = 250_000, forget: str = "1 hour") -> DataFrame:
    """played_ranges online: the state of a media is its anchor (position, wall, rate), forgotten once the watermark of ts is past
    its last report by the time forget. A batch's reports are taken in order; those behind the last one before are ignored."""
    silence = int(pd.Timedelta(forget).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        wall, seq, anchor, since, speed = tuple(held.get) if held.exists else (None,) * 5
        if wall is not None and held.getCurrentWatermarkMs() > wall // 1000 + silence:  # new reports came before the timer
            anchor = since = speed = None
        out = []
        rows = pd.concat(list(parts)).sort_values(["wall_us", "seq"])
        for now, n, kind, position, rate in zip(*(rows[c].tolist() for c in ("wall_us", "seq", "kind", "position_us", "rate")), strict=True):
            if wall is not None and (now, n) <= (wall, seq):
                continue
            wall, seq = now, n
            if kind == "interrupt":
                anchor = since = speed = None
            elif kind == "resume":
                since = None if anchor is None else now
            elif kind == "observe":
                if anchor is not None and rate == speed and 0 < position - anchor <= speed * (now - since) + slack:
                    out.append((key[0], anchor, int(position)))
                anchor, since, speed = int(position), now, rate
        held.update((wall, seq, anchor, since, speed))
        held.setTimeoutTimestamp(max((wall or 0) // 1000, held.getCurrentWatermarkMs()) + silence)
        yield pd.DataFrame(out, columns=[KEY, "start_us", "end_us"])

    rows = reports.select(KEY, "ts", "wall_us", "seq", "kind", "position_us", "rate")
    return rows.groupBy(KEY).applyInPandasWithState(run, f"{KEY} bigint, start_us bigint, end_us bigint", "wall bigint, seq bigint, anchor bigint, since bigint, speed double", "append", GroupStateTimeout.EventTimeTimeout)


def progress_monitor(events: DataFrame) -> DataFrame:
    """Per run and stage: latest done and total by sequence, and failures; a stream of it is in update mode."""
    return events.groupBy("run_id", "stage").agg(F.max_by("done", "seq").alias("done"), F.max_by("total", "seq").alias("total"), F.count_if(F.col("failed")).alias("n_failed"))


def routing_metrics(observed: DataFrame, routed: DataFrame) -> DataFrame:
    """Per media: observed, routed, skipped, and a digest of the routed times in order."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("ts_us")), "\n"), 256)
    r = routed.groupBy(KEY).agg(F.count("*").alias("n_routed"), digest.alias("digest"))
    out = observed.groupBy(KEY).agg(F.count("*").alias("n_observed")).join(r, KEY, "left").na.fill(0, ["n_routed"])
    return out.withColumn("n_skipped", F.col("n_observed") - F.col("n_routed"))


def routing_windows(samples: DataFrame, core: str, routed: Column) -> DataFrame:
    """routing_metrics of each tumbling core of event time, for append mode: a core is given out once the watermark is past it,
    so the times that its digest holds are bounded by the core."""
    times = F.array_sort(F.collect_list(F.when(routed, F.col("ts_us"))))
    out = samples.groupBy(KEY, F.window("ts", core).alias("w")).agg(F.count("*").alias("n_observed"), F.count_if(routed).alias("n_routed"), F.sha2(F.array_join(times, "\n"), 256).alias("digest"))
    return out.select(KEY, F.unix_micros("w.start").alias("start_us"), "n_observed", "n_routed", (F.col("n_observed") - F.col("n_routed")).alias("n_skipped"), F.when(F.col("n_routed") > 0, F.col("digest")).alias("digest"))
