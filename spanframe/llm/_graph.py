"""Connected components as alternating star contractions; edges and labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base
from ._base import drop_stored, join_heavy, stored


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    moved = join_heavy(both.where("b > a"), least, ["a"], "n", total=2 * total)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_heavy(down, least, ["a"], "n", total=2 * total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b): bigint node ids. Returns (node, component) for each node that has an edge; component is the smallest id
    reachable. Each round leaves a forest of shallower stars; the rounds grow with the logarithm of a component's size. A
    node of very many edges is joined by a broadcast of its row, so no task gathers its edges."""
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _digest(now)
    while True:
        at = len(_base._tables)
        now = stored(_small_star(_large_star(now, seen[0]), seen[0]), "edges")
        drop_stored(spark, at - 1, at)
        if (new := _digest(now)) == seen:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        seen = new
