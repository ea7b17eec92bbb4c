"""Greedy selection with a least gap, on arrays, and for timelines that no task can hold by pointer doubling.

A point's successor is the first one of its timeline at least gap later; what is selected is what successors reach from the
timeline's first point. In a batch of sorted rows that is a few array operations, with the last selected point carried over.

For long timelines the unit is a chunk of the time axis, at least gap long. Whatever was selected before a chunk, the first point
selected in it is one of its entries: its points within gap of its start, and the first one after these. A chunk maps each
entry to its last selected point, and so to an entry of the next chunk, or, where all of that chunk's points come too early,
to the first point of the one after. A chunk whose predecessor is empty begins with its first point. Doubling these pointers
reaches the entry of every chunk in logarithmically many joins, and each chunk is then selected from its entry alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stored
from .timeline import KEY, as_of


def successors(run: np.ndarray, t: np.ndarray, gap: int) -> np.ndarray:
    """For rows in the order (run, t): the first row of the same run at least gap later, or the number of rows."""
    n = len(t)
    order = np.lexsort((np.repeat([1, 0], n), np.concatenate((t, t + gap)), np.concatenate((run, run))))
    asked = order >= n
    at = np.empty(n, np.int64)
    at[order[asked] - n] = np.cumsum(~asked)[asked]  # rows before (run, t + gap)
    return np.where((at < n) & (run[np.minimum(at, n - 1)] == run), at, n)


def reached(after: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows the pointers after (the number of rows: none) reach from the rows start, these included."""
    n = len(after)
    mark = np.zeros(n + 1, bool)
    mark[start] = True
    step = np.append(after, n)
    while (step[:n] < n).any():
        mark[step[mark]] = True
        step = step[step]
    return mark[:n]


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Numbers of runs of equal values, for rows sorted by the columns (nulls are equal)."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _select(gaps: Sequence[int]) -> Callable[[pa.RecordBatch], list[np.ndarray]]:
    """A function that gets a partition's batches (media_id, time, ..) in order, and tells for each gap which rows it takes."""
    key: list[object] = [None]
    last: dict[int, int | None] = dict.fromkeys(gaps)

    def take(b: pa.RecordBatch) -> list[np.ndarray]:
        runs, t = _runs([b.column(0)]), b.column(1).to_numpy()
        goes_on, end = b.column(0)[0].as_py() == key[0], int(np.searchsorted(runs, 0, side="right"))
        out = []
        for gap in gaps:
            start = np.flatnonzero(np.diff(runs, prepend=-1))
            if goes_on and last[gap] is not None:
                start[0] = np.searchsorted(t[:end], last[gap] + gap)
                start = start[1:] if start[0] == end else start
            else:
                last[gap] = None
            out.append(reached(successors(runs, t, gap), start))
            mine = np.flatnonzero(out[-1] & (runs == runs[-1]))
            if len(mine):
                last[gap] = int(t[mine[-1]])
            elif runs[-1]:
                last[gap] = None
        key[0] = b.column(0)[-1].as_py()
        return out

    return take


def min_gap(points: DataFrame, gap: int, ts: str) -> DataFrame:
    """(media_id, ts): greedily the first, then each first point at least gap after the last one; one pass a timeline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = _select([gap])
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(take(b)[0]))

    rows = points.select(KEY, F.col(ts).cast("bigint").alias(ts)).where(F.col(ts).isNotNull())
    return rows.repartition(F.struct(KEY)).sortWithinPartitions(KEY, ts).mapInArrow(run, T.StructType([points.schema[KEY], T.StructField(ts, T.LongType())]))


def held_by(points: DataFrame, gaps: Mapping[str, int], ts: str, tie: Sequence[str]) -> DataFrame:
    """(media_id, tie, held): points that any of the named gaps selects, in the order of ts, then tie, with the names; one pass."""
    names, schema = list(gaps), T.StructType([points.schema[KEY], *(points.schema[c] for c in tie), T.StructField("held", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = _select(list(gaps.values()))
        for b in batches:
            if not b.num_rows:
                continue
            taken = np.stack(take(b), axis=1)
            any_ = taken.any(axis=1)
            ends = np.concatenate(([0], np.cumsum(taken[any_].sum(axis=1)))).astype(np.int32)
            said = pa.array(np.array(names, dtype=object)[np.nonzero(taken[any_])[1]].tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(pa.array(any_)) for i in (0, *range(2, b.num_columns))), pa.ListArray.from_arrays(pa.array(ends), said)], names=schema.names)

    rows = points.select(KEY, F.col(ts).cast("bigint").alias(ts), *tie).where(F.col(ts).isNotNull())
    return rows.repartition(F.struct(KEY)).sortWithinPartitions(KEY, ts, *tie).mapInArrow(run, schema)


def dedupe_close(points: DataFrame, tol: int, ts: str, scene: str, ident: str) -> DataFrame:
    """(media_id, ts, scene, ident): what is kept of points in the order (time, scene first, ident); see sampling.dedupe_close.

    The point that follows a kept one, as another one kept or in its place, is the first beyond tol, or the first scene point
    if the kept one is none: pointers again. A kept point is given out if what follows is not in its place. The last one of a
    batch is held back and leads the next batch."""
    schema = T.StructType([points.schema[KEY], *(points.schema[c] for c in (ts, scene, ident))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = _joined([held, b])
            runs, t, is_scene = _runs([b.column(0)]), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            n = len(t)
            end = np.searchsorted(runs, runs, side="right")
            beyond = np.minimum(successors(runs, t, tol + 1), end)  # the end of the run: none
            scenes = np.where(is_scene, np.arange(n), n)
            coming = np.append(np.minimum.accumulate(scenes[::-1])[::-1], n)[1:]  # the next scene point
            replaced = ~is_scene & (coming < beyond)
            after = np.where(replaced, coming, np.where(beyond < end, beyond, n))
            taken = reached(after, np.flatnonzero(np.diff(runs, prepend=-1)))
            last = int(np.flatnonzero(taken)[-1])
            held = b.slice(last, 1)
            taken &= ~replaced
            taken[last] = False
            yield b.filter(pa.array(taken))
        if held is not None:
            yield held

    rows = points.select(*schema.names).where(F.col(ts).isNotNull()).withColumn(scene, F.coalesce(scene, F.lit(False)))
    spread = rows.repartition(F.struct(KEY)).sortWithinPartitions(F.col(KEY), F.col(ts), ~F.col(scene), F.col(ident))
    return spread.mapInArrow(run, schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Batches that end where a group (equal first key columns) ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = bool(held) and all(held[-1].column(i)[-1] == b.column(i)[0] for i in range(key))
        cut = int(np.searchsorted(runs := _runs(b.columns[:key]), runs[-1]))
        if not same and held:
            yield _joined(held)
            held = []
        if cut:
            yield _joined([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _entries(points: DataFrame, gap: int, chunk: int) -> DataFrame:
    """(media_id, chunk, entry, last): where the selection may enter each chunk, and the last point it then takes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches, 2):
            runs, t = _runs(b.columns[:2]), b.column(2).to_numpy()
            after = successors(runs, t, gap)
            n = len(t)
            step = np.where(after < n, after, np.arange(n))
            while (step[step] != step).any():
                step = step[step]
            head = t < b.column(1).to_numpy() * chunk + gap
            head |= np.append(False, (runs[1:] == runs[:-1]) & head[:-1]) | (np.diff(runs, prepend=-1) > 0)
            pick = np.flatnonzero(head)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pick)), b.column(1).take(pa.array(pick)), pa.array(t[pick]), pa.array(t[step[pick]])], names=[KEY, "chunk", "entry", "last"])

    schema = T.StructType([points.schema[KEY], *(T.StructField(c, T.LongType()) for c in ("chunk", "entry", "last"))])
    return points.select(KEY, "chunk", "t").repartition(F.struct(KEY, "chunk")).sortWithinPartitions(KEY, "chunk", "t").mapInArrow(run, schema)


def _pointers(entries: DataFrame, gap: int) -> DataFrame:
    """(media_id, chunk, entry, to_chunk, to_entry) for entries whose timeline goes on without an empty chunk."""
    ends = entries.select(KEY, (F.col("chunk") + 1).alias("chunk"), "last", (F.col("last") + gap).alias("need")).distinct()
    found = as_of(ends, entries.select(KEY, "chunk", F.col("entry").alias("mark_us")), ts="need", key=(KEY, "chunk")).drop("prev_us")
    first = entries.groupBy(KEY, "chunk").agg(F.min("entry").alias("first"))
    here = found.join(first.withColumnRenamed("first", "here"), [KEY, "chunk"])  # the next chunk is not empty
    beyond = first.select(KEY, (F.col("chunk") - 1).alias("chunk"), F.col("first").alias("beyond"))
    to = here.join(beyond, [KEY, "chunk"], "left").where("next_us is not null or beyond is not null")
    to = to.select(KEY, (F.col("chunk") - 1).alias("chunk"), "last", F.when(F.col("next_us").isNull(), F.col("chunk") + 1).otherwise(F.col("chunk")).alias("to_chunk"), F.coalesce("next_us", "beyond").alias("to_entry"))
    return entries.join(to, [KEY, "chunk", "last"]).select(KEY, "chunk", "entry", "to_chunk", "to_entry")


def min_gap_chunked(points: DataFrame, gap: int, ts: str, chunk: int) -> DataFrame:
    """min_gap for timelines of any length: a task holds a chunk of chunk microseconds (at least gap), not a timeline."""
    chunk = max(chunk, gap)
    rows = points.select(KEY, F.col(ts).cast("bigint").alias("t")).where("t is not null").distinct()
    rows = rows.withColumn("chunk", F.floor(F.col("t") / F.lit(chunk)).cast("bigint"))
    entries = stored(_entries(rows, gap, chunk), "entries")
    pointers = stored(_pointers(entries, gap), "pointers")
    before = entries.select(KEY, (F.col("chunk") + 1).alias("chunk")).distinct()
    now = entries.groupBy(KEY, "chunk").agg(F.min("entry").alias("entry")).join(before, [KEY, "chunk"], "left_anti")
    while pointers.take(1):
        more = now.join(pointers, [KEY, "chunk", "entry"]).select(KEY, F.col("to_chunk").alias("chunk"), F.col("to_entry").alias("entry"))
        now = stored(now.union(more).distinct(), "reached")
        onward = pointers.select(KEY, F.col("chunk").alias("to_chunk"), F.col("entry").alias("to_entry"), F.col("to_chunk").alias("c2"), F.col("to_entry").alias("e2"))
        pointers = stored(pointers.join(onward, [KEY, "to_chunk", "to_entry"]).select(KEY, "chunk", "entry", F.col("c2").alias("to_chunk"), F.col("e2").alias("to_entry")), "pointers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches, 2):
            runs, t, entry = _runs(b.columns[:2]), b.column(2).to_numpy(), b.column(3).to_numpy()
            taken = reached(successors(runs, t, gap), np.flatnonzero(t == entry))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(taken)), pc.filter(b.column(2), pa.array(taken))], names=[KEY, ts])

    chosen = rows.join(now, [KEY, "chunk"]).select(KEY, "chunk", "t", "entry").repartition(F.struct(KEY, "chunk")).sortWithinPartitions(KEY, "chunk", "t")
    return chosen.mapInArrow(run, T.StructType([points.schema[KEY], T.StructField(ts, T.LongType())]))
