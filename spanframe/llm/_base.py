"""Shared helpers: reading tables, cutting lineage with tables in the cluster's shared folder, joins that hot keys do not
slow down, and running sums that no task gathers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key of more rows than this, or than one in HEAVY_KEYS of all rows, meets its rows by a broadcast.
HEAVY, HEAVY_KEYS = 50_000, 50_000
_tables: list[str] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where that is unset: a temporary one on a single machine
    (local masters, as in tests), an error elsewhere, because other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spanframe-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanframe/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage is cut, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Deletes stored tables, those of the numbers first to last in the order of writing; nothing may read them any more."""
    for path in _tables[first:last]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _tables[first:last]


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make() as a stored table; all that it stored on its way is deleted."""
    first = len(_tables)
    out = stored(make(), name)
    drop_stored(spark, first, -1)
    return out


def join_heavy(rows: DataFrame, table: DataFrame, on: Sequence[str], n: str, *, total: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined (inner or left_anti) to table, which holds a key once and in n how many rows have it (n is dropped).

    Keys of more than HEAVY rows, of which there are HEAVY_KEYS at most, are broadcast, so that their rows stay where they
    are; all others meet by a shuffle, or as Spark sees fit. total: a bound of the rows, if known. table is read several
    times.
    """
    on = list(on)
    if total is None or total > HEAVY:
        got = table.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
        limit = max(HEAVY, (got["all"] or 0) // HEAVY_KEYS)
        if (got["most"] or 0) > limit:
            heavy, light = F.broadcast(table.where(F.col(n) > limit).drop(n)), table.where(F.col(n) <= limit).drop(n)
            rest = rows.join(F.broadcast(heavy.select(on)), on, "left_anti")
            if how == "left_anti":
                return rest.join(light.select(on), on, how)
            return rest.join(light, on).unionByName(rows.join(heavy, on))
    return rows.join(table.select(on) if how == "left_anti" else table.drop(n), on, how)


def split_repeats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with one row of each id (null is one too) and text, and the rows that repeat one; None where there is none, as is usual.

    Which of equal rows is the first is settled by a number that they get as they are stored; rows that repeat nothing stay
    where they are. Null texts repeat nothing."""
    keys = ["__k", "__k2"]
    parts = (F.col(id_col), F.col(id_col).isNull(), F.col(text_col))
    keyed = docs.withColumns({"__k": F.xxhash64(*parts), "__k2": F.hash(*parts)})
    counts = stored(keyed.where(F.col(text_col).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1"), "repeats")
    if not counts.take(1):
        return docs, None
    many = stored(join_heavy(keyed, counts, keys, "__n").withColumn("__no", F.monotonically_increasing_id()), "repeated")
    first = many.groupBy(*keys).agg(F.min("__no").alias("__first"), F.count("*").alias("__n"))
    told = join_heavy(many, stored(first, "firsts"), keys, "__n")
    alone = join_heavy(keyed, counts, keys, "__n", how="left_anti")
    once = alone.select(docs.columns).unionByName(told.where("__no = __first").select(docs.columns))
    return once, told.where("__no <> __first").select(docs.columns)


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, str], name: str) -> DataFrame:
    """df with a column for each of sums (name: column), the sum over all rows before in the order given, and row (from 1).

    The order must be total. Ranges of rows are summed first: one task sees a range, or one number of each range.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = {**{f"__{k}": F.sum(c) for k, c in sums.items()}, "__row": F.count("*")}
    totals = parts.groupBy("__range").agg(*(c.alias(k) for k, c in every.items()))
    totals = totals.select("__range", *(F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(k) for k in every))
    out = parts.join(F.broadcast(totals), "__range")
    out = out.withColumns({k: F.col(f"__{k}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()})
    return out.withColumn("row", F.col("__row") + F.count("*").over(within) + 1).drop("__range", *every)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
