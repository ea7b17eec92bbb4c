"""Exact top-k by inner product, pruned with segment statistics from coarse to fine.

With a vector cut into segments of length s, means m and deviations d, a squared distance has the lower bound
sum(s * ((m - m')^2 + (d - d')^2)) over segments, or equally an inner product the upper bound sum(s * (m m' + d d')): the
deviations from the means cannot add more than d d' (Cauchy and Schwarz). The bound of a level is itself an inner product of
two numbers a segment, so a block of queries meets a block of candidates in one matrix product. Levels double the segments;
only pairs whose bound reaches the query's k-th best exact score so far go on, and what is left gets exact scores.

Candidates are stored as blocks of vectors where they lie, without a shuffle. Queries are taken in chunks of bounded bytes:
a chunk is broadcast, the blocks are scanned, and a task hands on the k best of all its blocks for each query, as each
query's k-th best score so far is its floor in the task's next block. A share of the blocks is searched first; what it
gives is the floor for the rest, where most pairs then end at the coarsest level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import scratch_path, stored
from ._vectors import Best, largest_square, packed

#: Vectors and components of a block of candidates at most; bytes of a chunk of queries, about.
CANDIDATES, COMPONENTS, CHUNK_BYTES = 8192, 1 << 20, 1 << 24
#: The share of blocks searched first (one in FIRST), where there are more than four times as many.
FIRST = 64
#: Queries of a chunk that are scored together.
TOGETHER = 128


def _levels(dim: int) -> list[int]:
    out, n = [], 2
    while n <= dim // 2:
        out.append(n)
        n *= 2
    return out


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(length) * (means, deviations) of the segments, of which the last may be shorter."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    root = np.sqrt([p.shape[1] for p in parts])
    return np.concatenate((np.stack([p.mean(axis=1) for p in parts], axis=1) * root, np.stack([p.std(axis=1) for p in parts], axis=1) * root), axis=1)


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, best: Best) -> None:
    """Takes into best what the queries find in a block of candidates, other than rows of their own id."""
    levels, k = _levels(q.shape[1]), best.k
    of_q, of_c = ([_statistics(x, n) for n in levels] for x in (q, c))
    slack = 1e-9 * (1 + np.abs(q).sum(axis=1)) * (1 + np.abs(c).max(initial=0))
    for at in range(0, len(q), TOGETHER):
        part = slice(at, at + TOGETHER)
        mine = np.arange(at, min(at + TOGETHER, len(q)))
        alive = q_ids[part, None] != c_ids[None, :]
        floor = best.floors(mine)
        if levels:
            bound = np.where(alive, of_q[0][part] @ of_c[0].T, -np.inf)
            if bound.shape[1] > k and np.isinf(floor).any():  # exact scores of the most promising give the first floor
                first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                exact = np.einsum("qd,qkd->qk", q[part], c[first])
                exact = np.where(np.take_along_axis(alive, first, axis=1), exact, -np.inf)
                floor = np.maximum(floor, exact.min(axis=1))
            least = (floor - slack[part])[:, None]
            alive &= bound >= least
            for a, b in zip(of_q[1:], of_c[1:], strict=True):
                row, col = np.nonzero(alive)
                if len(row) > alive.size // 8:  # most are left: one product is cheaper than picking pairs
                    alive &= a[part] @ b.T >= least
                else:
                    for i in range(0, len(row), 65536):
                        r, s = row[i : i + 65536], col[i : i + 65536]
                        alive[r, s] = np.einsum("nd,nd->n", a[part][r], b[s]) >= least[r, 0]
        found = []
        for r in range(alive.shape[0]):
            cols = np.flatnonzero(alive[r])
            scores = c[cols] @ q[at + r]
            top = np.lexsort((c_ids[cols], -scores))[:k]
            found.append((np.full(len(top), at + r), scores[top], c_ids[cols][top]))
        best.merge(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _blocks(rows: DataFrame) -> DataFrame:
    """(dim, ids, points, first): blocks of vectors of one length, made of a task's own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, v = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([b"".join(v)], pa.binary())], names=["dim", "ids", "points"])

        for b in batches:
            for dim, ident, v in zip(*(b.column(c).to_pylist() for c in ("dim", "id", "v")), strict=True):
                held.setdefault(dim, []).append((ident, v))
                if len(held[dim]) == max(1, min(CANDIDATES, COMPONENTS // dim)):
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    made = rows.select("id", "dim", "v").mapInArrow(run, "dim int, ids array<bigint>, points binary")
    return stored(made.withColumn("first", F.pmod(F.xxhash64("ids"), F.lit(FIRST)) == 0), "vector_blocks")


def _scan(blocks: DataFrame, held: Broadcast, k: int) -> DataFrame:
    """(no, id, score): the k best that each task finds for each query in its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {}
        for dim in {x["dim"] for x in held.value}:
            mine = [x for x in held.value if x["dim"] == dim]
            q = np.frombuffer(b"".join(x["v"] for x in mine), "<f8").reshape(len(mine), dim)
            no, ids, floors = (np.array([x[c] for x in mine]) for c in ("no", "id", "floor"))
            searches[dim] = (no, q, ids, Best(len(mine), k, floors))
        for b in batches:
            for dim, ids, points in zip(b.column("dim").to_pylist(), b.column("ids"), b.column("points"), strict=True):
                if dim in searches:
                    _, q, q_ids, best = searches[dim]
                    search_block(q, q_ids, np.frombuffer(points.as_buffer(), "<f8").reshape(-1, dim), ids.values.to_numpy(), best)
        for no, _, _, best in searches.values():
            a, r = np.nonzero(np.isfinite(best.scores))
            yield pa.RecordBatch.from_arrays([pa.array(no[a]), pa.array(best.ids[a, r]), pa.array(best.scores[a, r].astype(np.int64))], names=["no", "id", "score"])

    return blocks.select("dim", "ids", "points").mapInArrow(run, "no bigint, id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest inner products of floor(scale * component) with all rows but its own.

    Returns query_id, rank (from 1), <id_col>, score (bigint); ties go to the smaller id. Vectors that are null, empty, or
    hold null or non-finite components take no part, nor do null ids. Vectors of different lengths never meet. Rows that
    repeat an id are candidates each, and queries each, with a list of its own; none is a candidate of its own id. Scores
    are exact: squared norms of 2**53 and more are refused by an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stored(packed(vectors, is_query, F.lit(""), scale=scale, id_col=id_col, vector_col=vector_col), "vectors")
    largest_square(rows)
    queries, blocks = rows.where("chosen"), _blocks(rows)
    many = blocks.count() > 4 * FIRST
    chunks = -(-(queries.agg(F.sum(F.length("v") + 64)).first()[0] or 0) // CHUNK_BYTES)
    path = scratch_path(spark, "top_k")
    for i in range(chunks):
        chunk = [r.asDict() | {"floor": -np.inf} for r in queries.where(F.pmod(F.xxhash64("no"), F.lit(chunks)) == i).select("no", "id", "dim", "v").collect()]
        shared = [spark.sparkContext.broadcast(chunk)]
        found = _scan(blocks.where("first") if many else blocks, shared[0], k)
        if many:
            found = stored(_ranked(found, k), "first_share")
            floors = {r["no"]: float(r["score"]) for r in found.where(F.col("rank") == k).collect()}  # one number a query
            raised = [x | {"floor": floors.get(x["no"], -np.inf)} for x in chunk]
            shared.append(spark.sparkContext.broadcast(raised))
            found = found.drop("rank").union(_scan(blocks.where("not first"), shared[1], k))
        named = _ranked(found, k).join(queries.select("no", F.col("id").alias("query_id")), "no")
        named.select("query_id", "rank", F.col("id").alias(id_col), "score").write.parquet(f"{path}/chunk={i}")
        for held in shared:
            held.destroy()
    if not chunks:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score bigint")
    return spark.read.schema(f"query_id bigint, rank int, {id_col} bigint, score bigint, chunk int").parquet(path).drop("chunk")
