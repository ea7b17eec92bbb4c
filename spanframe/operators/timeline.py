"""Building blocks of keyed timelines: islands, binned range joins, as-of lookups, ordered passes. Times are microseconds."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KEY = "media_id"


def gap_islands(points: DataFrame, gap: int, *, ts: str = "ts_us", key: Sequence[str] = (KEY,), tie: Sequence[str] = (), name: str = "island") -> DataFrame:
    """Numbers groups of points whose neighbours are at most gap apart, from 0 for each key."""
    w = Window.partitionBy(*key).orderBy(ts, *tie)
    new = F.when(F.col(ts) - F.lag(ts).over(w) > gap, 1).otherwise(0)
    return points.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def interval_islands(intervals: DataFrame, gap: int = 0, *, start: str = "start_us", end: str = "end_us", key: Sequence[str] = (KEY,), name: str = "island") -> DataFrame:
    """Numbers groups of intervals: one starts a group if it starts more than gap behind all ends before it."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) > before + gap, 1).otherwise(0)
    return intervals.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def range_join(left: DataFrame, right: DataFrame, *, width: int, key: Sequence[str] = (KEY,), tol: int = 0, prefix: str = "r_", unmatched: Sequence[str] = ()) -> DataFrame:
    """Pairs of a key whose closed intervals (start_us, end_us) overlap, the left ones widened by tol.

    Both sides go into bins of width; a pair is kept in the bin of its later start alone, so nothing is paired twice and no
    key becomes one task. width should be about a usual interval's length. Right columns get prefix. unmatched: columns that
    identify a left row; if given, left rows without a partner are kept.
    """
    a = left.withColumn("__from", F.col("start_us") - tol).withColumn("__to", F.col("end_us") + tol)
    a = a.withColumn("__bin", F.explode(_bins(F.col("__from"), F.col("__to"), width)))
    b = right.select(*(F.col(c).alias(f"{prefix}{c}") for c in right.columns))
    b = b.withColumn("__rbin", F.explode(_bins(F.col(f"{prefix}start_us"), F.col(f"{prefix}end_us"), width)))
    on = [F.col(k) == F.col(f"{prefix}{k}") for k in key] + [F.col("__bin") == F.col("__rbin")]
    met = (F.col("__from") <= F.col(f"{prefix}end_us")) & (F.col(f"{prefix}start_us") <= F.col("__to"))
    own = F.col("__bin") == F.floor(F.greatest("__from", f"{prefix}start_us") / width)
    drop = ["__bin", "__rbin", "__from", "__to", *(f"{prefix}{k}" for k in key)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    pairs = a.join(b, cond).where(met & own).drop(*drop)
    if not unmatched:
        return pairs
    alone = left.join(pairs.select(*unmatched).distinct(), list(unmatched), "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def points_in_intervals(points: DataFrame, intervals: DataFrame, *, width: int, ts: str = "ts_us", tol: int = 0, prefix: str = "i_") -> DataFrame:
    """Pairs of a point and a closed interval that holds it, the intervals widened by tol on both sides."""
    wide = intervals.withColumn("__lo", F.col("start_us") - tol).withColumn("__hi", F.col("end_us") + tol)
    b = wide.select(*(F.col(c).alias(f"{prefix}{c}") for c in intervals.columns), "__lo", "__hi", F.explode(_bins(F.col("__lo"), F.col("__hi"), width)).alias("__ibin"))
    a = points.withColumn("__bin", F.floor(F.col(ts) / width))
    on = (F.col(KEY) == F.col(f"{prefix}{KEY}")) & (F.col("__bin") == F.col("__ibin")) & F.col(ts).between(F.col("__lo"), F.col("__hi"))
    return a.join(b, on).drop("__bin", "__ibin", "__lo", "__hi", f"{prefix}{KEY}")


def as_of(points: DataFrame, marks: DataFrame, *, ts: str = "ts_us", mark: str = "mark_us", key: Sequence[str] = (KEY,), payload: Sequence[str] = ()) -> DataFrame:
    """Each point with the nearest mark at or before it (prev_us) and at or after it (next_us), by one sort of the union.

    payload columns of marks come along as prev_<name>. Marks of equal time: the last by payload.
    """
    p = points.select(*points.columns, F.col(ts).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__m"), *(F.lit(None).cast(marks.schema[c].dataType).alias(f"__p_{c}") for c in payload))
    m = marks.select(*key, F.col(mark).alias("__t"), F.lit(0).alias("__kind"), F.col(mark).cast("bigint").alias("__m"), *(F.col(c).alias(f"__p_{c}") for c in payload))
    both = p.unionByName(m, allowMissingColumns=True)
    back = Window.partitionBy(*key).orderBy("__t", "__kind", *(f"__p_{c}" for c in payload)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(F.col("__t").desc(), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("prev_us", F.last("__m", True).over(back)).withColumn("next_us", F.last("__m", True).over(ahead))
    for c in payload:
        out = out.withColumn(f"prev_{c}", F.last(f"__p_{c}", True).over(back))
    return out.where("__kind = 1").drop("__t", "__kind", "__m", *(f"__p_{c}" for c in payload))


def ordered_pass(rows: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """(key, schema) of what fold makes of each key's rows, which it gets one by one in order, as tuples of columns.

    For rules whose anchor is the last kept row. Rows are sorted by Spark and stream through the task: nothing of a timeline
    is held but what fold itself holds, however long the timeline is. A window numbers the rows because it needs a key's rows in one
    task: a mere repartition is left out behind a join by the key, whose side adaptive execution may read as it was written.
    """
    names, k = [*key, *columns], len(key)
    out = T.StructType([*(rows.schema[c] for c in key), *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made: list[tuple] = []
        for group, mine in itertools.groupby(stream, key=lambda r: r[:k]):
            for row in fold(r[k:-1] for r in mine):
                made.append(group + tuple(row))
                if len(made) == 10_000:
                    yield batch(made)
                    made = []
        if made:
            yield batch(made)

    arrow = to_arrow_schema(out)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    spread = rows.select(*names, *(c for c in order if c not in names)).withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return spread.select(*names, "__place").mapInArrow(run, out)
