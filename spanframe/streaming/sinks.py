"""Sinks for foreachBatch that a retried batch does not repeat, and a listener of a query's progress.

What a batch writes stands under its number (batch=<id>), and is replaced if the batch comes again: after a failure Spark
hands out the same batch under the same number, so each row is there once. A sink's folder belongs to one query.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Sink = Callable[[DataFrame, int], None]
_FAILURES = "sink string, batch bigint, attempt int, error string"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def table_sink(path: str) -> Sink:
    """Writes each batch to path/batch=<id>, over what an earlier try left there."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_sink(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches, with the number of their batch; empty if there is none yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)


def read_latest(spark: SparkSession, path: str, schema: str, by: Sequence[str]) -> DataFrame:
    """The last row of each key that update-mode batches have written: an upsert, resolved when it is read."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("batch").desc()))
    return read_sink(spark, path, schema).withColumn("__n", last).where("__n = 1").drop("__n", "batch")


def fan_out(sinks: Mapping[str, Sink], ledger: str, *, attempts: int = 1, strict: bool = False) -> Sink:
    """A batch function that feeds each sink; one that fails is tried up to attempts times, and the others go on.

    ledger: a folder of this query. done/<sink>/batch=<id> marks what a sink has taken, and is passed over if the batch is
    retried; failures/batch=<id>, which read_failures reads, holds the failures of its last run. strict: a sink that failed
    at every attempt fails the batch in the end, so that a restart retries it, for that sink alone; else its batch is lost
    to it, and the table says so.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, failed, left = batch.sparkSession, [], []
        batch = batch.persist()
        try:
            for name, sink in sinks.items():
                done = f"{ledger}/done/{name}/batch={number}"
                if _exists(spark, done):
                    continue
                for attempt in range(1, attempts + 1):
                    try:
                        sink(batch, number)
                        spark.range(1).write.mode("overwrite").parquet(done)
                        break
                    except Exception as e:  # isolation is the point
                        failed.append((name, number, attempt, f"{type(e).__name__}: {e}"[:400]))
                else:
                    left.append(name)
        finally:
            batch.unpersist()
        if failed:
            spark.createDataFrame(failed, _FAILURES).drop("batch").write.mode("overwrite").parquet(f"{ledger}/failures/batch={number}")
        if left and strict:
            raise RuntimeError(f"batch {number} failed for {', '.join(left)}")

    return run


def read_failures(spark: SparkSession, ledger: str) -> DataFrame:
    """(sink, attempt, error, batch) of all batches."""
    return read_sink(spark, f"{ledger}/failures", "sink string, attempt int, error string")


def late_audit(on_time: Sink, dead: Sink, marks: str, *, delay_us: int, ts: str = "ts_us") -> Sink:
    """A batch function that parts late rows from the others: those at or behind the watermark of the batches before, which is
    the greatest time they held less delay_us. Rows without a time are late.

    It needs the raw stream, before any operator that drops late rows (Spark's own operators drop those that are late by the
    watermark one batch older: a part of these). marks: a folder for each batch's greatest time, kept by
    number, so that a retried batch meets the same watermark; a batch reads only the mark of the one before.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = None
        if number and _exists(spark, f"{marks}/batch={number - 1}"):
            before = spark.read.schema("most bigint").parquet(f"{marks}/batch={number - 1}").first()["most"]
        late = F.col(ts).isNull() if before is None else F.coalesce(F.col(ts) <= before - delay_us, F.lit(True))
        batch = batch.persist()
        try:
            most = batch.agg(F.greatest(F.max(ts), F.lit(before).cast("bigint")).alias("most"))
            most.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={number}")
            on_time(batch.where(~late), number)
            dead(batch.where(late).withColumn("watermark_us", F.lit(None if before is None else before - delay_us).cast("bigint")), number)
        finally:
            batch.unpersist()

    return run


class ProgressListener(StreamingQueryListener):
    """Batches, rows, the last rate and the failure of each query, by its name or id; failure is None while it runs."""

    def __init__(self) -> None:
        self.seen: dict[str, dict] = {}
        self._lock = threading.Lock()
        self._names: dict[str, str] = {}

    def _of(self, ident: object, name: str | None = None) -> dict:
        key = self._names.setdefault(str(ident), name or str(ident))
        return self.seen.setdefault(key, {"batches": 0, "rows": 0, "rows_per_second": None, "failure": None, "ended": False})

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self._of(event.id, event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        said = event.progress
        with self._lock:
            mine = self._of(said.id, said.name)
            mine["batches"] += said.numInputRows > 0
            mine["rows"] += said.numInputRows
            if said.numInputRows:
                mine["rows_per_second"] = said.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            mine = self._of(event.id)
            mine["failure"], mine["ended"] = event.exception, True
