"""The library for SQL users: interval functions that Catalyst inlines, and table functions.

plan_chunks(duration_us, core) and phase_grid(gap, step) take numbers. min_gap(TABLE(t), key, ts, gap) and threshold_grid(TABLE(t),
key, column, n) take a table: they ask Spark to deal it out by the key column and to sort it, so no PARTITION BY is written, and
tell their columns from its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.sampling import phase_grid

FUNCTIONS = {
    "overlap_us": "(a BIGINT, b BIGINT, c BIGINT, d BIGINT) RETURNS BIGINT RETURN greatest(0L, least(b, d) - greatest(a, c))",
    "interval_iou": "(a BIGINT, b BIGINT, c BIGINT, d BIGINT) RETURNS DOUBLE RETURN coalesce(try_divide(CAST(overlap_us(a, b, c, d) AS DOUBLE), b - a + d - c - overlap_us(a, b, c, d)), 0D)",
    "owning_chunk": "(ts BIGINT, core BIGINT, dur BIGINT) RETURNS BIGINT RETURN CASE WHEN ts BETWEEN 0 AND dur THEN least(ts DIV core, greatest(1L, CAST(ceil(dur / core) AS BIGINT)) - 1) END",
}


@udtf(returnType="chunk bigint, core_start_us bigint, core_end_us bigint")
class Chunks:
    """plan_chunks(duration_us, core): the gap-free cores of a media."""

    def eval(self, duration_us: int, core: int) -> Iterator[tuple[int, int, int]]:
        for i in range(max(1, -(-duration_us // core))):
            yield i, i * core, min(duration_us, (i + 1) * core)


@udtf(returnType="phase bigint")
class PhaseGrid:
    """phase_grid(gap, step): phases 0, step, .. below gap, and the quarters of gap."""

    def eval(self, gap: int, step: int) -> Iterator[tuple[int]]:
        for phase in phase_grid(gap, step):
            yield (phase,)


def _column(table: AnalyzeArgument, name: AnalyzeArgument) -> StructField:
    """The field of a table argument that a constant text names."""
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    if not isinstance(name.value, str) or name.value not in table.dataType.names:
        raise ValueError(f"no column {name.value!r}; columns are named by constant texts")
    return table.dataType[name.value]


def _apart(key: AnalyzeArgument) -> list[PartitioningColumn]:
    """Rows of a key in one task. A structure around the column keeps Spark from leaving its exchange out where a join is already cut
    by the column: adaptive execution may then read the join's side as it was written, or split it, and a key is in several tasks."""
    return [PartitioningColumn(f"struct(`{key.value.replace('`', '``')}`)")]


@udtf
class MinGap:
    """min_gap(TABLE(t), key, ts, gap): the rows of t that are the first of their key, or the first at least gap after the last
    one taken. Rows of null times are left out. A key's rows stream through, and only the last time is held."""

    def __init__(self) -> None:
        self.last = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, ts: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        _column(rows, key), _column(rows, ts)
        return AnalyzeResult(schema=rows.dataType, partitionBy=_apart(key), orderBy=[OrderingColumn(ts.value)])

    def eval(self, row: Row, key: str, ts: str, gap: int) -> Iterator[tuple]:
        t = row[ts]
        if t is not None and (self.last is None or t - self.last >= gap):
            self.last = t
            yield tuple(row)


@udtf
class ThresholdGrid:
    """threshold_grid(TABLE(t), key, column, n): for each key the distinct values of a number column at n evenly spaced ranks
    (rounded half to even) of its sorted values. What is held are a key's distinct values and their numbers."""

    def __init__(self) -> None:
        self.values: list[list] = []
        self.key = self.n = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, column: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        _column(rows, column)
        schema = StructType([_column(rows, key), StructField("threshold", DoubleType())])
        return AnalyzeResult(schema=schema, partitionBy=_apart(key), orderBy=[OrderingColumn(column.value)])

    def eval(self, row: Row, key: str, column: str, n: int) -> None:
        self.key, self.n = row[key], n
        if (x := row[column]) is not None:
            if self.values and (self.values[-1][0] == x or (x != x and self.values[-1][0] != self.values[-1][0])):  # NaN is one value
                self.values[-1][1] += 1
            else:
                self.values.append([x, 1])

    def terminate(self) -> Iterator[tuple]:
        total = sum(k for _, k in self.values)
        ranks = sorted({round(i * (total - 1) / (self.n - 1)) if self.n > 1 else 0 for i in range(self.n or 0)}) if total else []
        at, upto = 0, 0
        for x, k in self.values:
            upto += k
            if at < len(ranks) and ranks[at] < upto:
                yield self.key, float(x)
                while at < len(ranks) and ranks[at] < upto:
                    at += 1


def register_functions(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    for name, function in (("plan_chunks", Chunks), ("phase_grid", PhaseGrid), ("min_gap", MinGap), ("threshold_grid", ThresholdGrid)):
        spark.udtf.register(name, function)
