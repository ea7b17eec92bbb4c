"""Hard negatives by inner product: each anchor's best rows of its own label, and for each of these the best rows of other
labels within a window below its score.

The upper levels of the cover tree are pivots, picked farthest first from a bounded sample; each row goes to its nearest
pivot, a pivot of many rows to several blocks, and each block is a cover tree of its own (cover_tree), stored. Anchors are a
stated query set, taken in chunks of bounded bytes: a chunk is broadcast, the stored trees are scanned where they lie, and a
task hands on what it found best in all of its trees. A share of the trees comes first and gives the floors for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import join_heavy, scratch_path, stored
from ._vectors import PACKED, largest_square, matrix, packed
from .cover_tree import NODES, Search, Tree, build

#: Vectors and components of a block at most, about; rows of the sample that pivots and first floors come from, and pivots.
BLOCK, BLOCK_COMPONENTS, SAMPLE, PIVOTS = 2048, 1 << 21, 1024, 256
#: Bytes of vectors of a chunk of anchors, about; the share of trees searched first (one in FIRST), where there are more.
CHUNK_BYTES, FIRST = 1 << 24, 64
_HITS = "no bigint, w int, other bigint, score bigint"


def _pivots(sample: list, sphere: float, n: dict[int, int]) -> dict[int, np.ndarray]:
    """For each dimension its pivots: rows of the sample, each the farthest from those before; one for each BLOCK rows."""
    out = {}
    for dim in n:
        x = np.array([np.frombuffer(r["v"], "<f8") for r in sample if r["dim"] == dim])
        if not len(x):
            continue
        x = np.column_stack((x, np.sqrt(np.maximum(0.0, sphere - (x * x).sum(axis=1)))))
        picks, dist = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(picks) < min(PIVOTS, len(x), max(1, n[dim] // BLOCK)) and dist.max() > 0:
            picks.append(int(dist.argmax()))
            dist = np.minimum(dist, ((x - x[picks[-1]]) ** 2).sum(axis=1))
        out[dim] = x[picks]
    return out


def _trees(rows: DataFrame, sphere: float, pivots: dict[int, np.ndarray]) -> DataFrame:
    """One row for each block: its dimension, points in the order of leaves, and the nodes."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, pivot = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                if (of := pivots.get(dim)) is not None and len(of) > 1:
                    same = np.flatnonzero(dims == dim)
                    x = matrix(b.column("v").take(pa.array(same)), dim)
                    last = np.sqrt(np.maximum(0.0, sphere - (x * x).sum(axis=1)))
                    pivot[same] = (x @ of[:, :-1].T + np.outer(last, of[:, -1])).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot)], names=[*b.schema.names, "pivot"])

    dealt = stored(rows.mapInArrow(assign, f"{PACKED}, pivot int"), "dealt")
    per_block = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_COMPONENTS) / F.col("dim"))))
    groups = dealt.groupBy("dim", "pivot").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / per_block))
    cut = join_heavy(dealt, groups, ["dim", "pivot"], "n").withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["v"]), "<f8").reshape(len(pdf), int(key[0]))
        order, nodes = build(x, sphere)
        made = {"dim": int(key[0]), "ids": pdf["id"].to_numpy()[order], "labels": pdf["label"].to_numpy()[order], "points": x[order].tobytes()}
        return pd.DataFrame([made | {k: nodes[k] for k in NODES}])

    schema = "dim int, ids array<bigint>, labels array<string>, points binary, " + ", ".join(f"{k} array<{'double' if k == 'radius' else 'bigint'}>" for k in NODES)
    return stored(cut.groupBy("dim", "pivot", "block").applyInPandas(grow, schema).withColumn("first", F.pmod(F.xxhash64("ids"), F.lit(FIRST)) == 0), "cover_trees")


def _searches(anchors: list[dict], k: int, same: bool) -> dict[int, tuple[np.ndarray, list[str], Search]]:
    """For each dimension the anchors' rows, their distinct labels, and the search; an anchor has windows (lo, hi)."""
    out = {}
    for dim in sorted({a["dim"] for a in anchors}):
        mine = [a for a in anchors if a["dim"] == dim]
        width = max(len(a["windows"]) for a in mine)
        pad = np.array([[*a["windows"], *[(np.inf, -np.inf)] * (width - len(a["windows"]))] for a in mine]).reshape(len(mine), width, 2)
        names, label = np.unique([a["label"] for a in mine], return_inverse=True)
        q = np.array([np.frombuffer(a["v"], "<f8") for a in mine]).reshape(len(mine), dim)
        raised = np.array([[*(a.get("floors") or ()), *[-np.inf] * (width - len(a.get("floors") or ()))] for a in mine]).reshape(len(mine), width)
        search = Search(q, np.array([a["id"] for a in mine]), label, np.maximum(pad[:, :, 0], raised), pad[:, :, 1], k, same)
        out[dim] = (np.array([a["no"] for a in mine]), names.tolist(), search)
    return out


def _scan(trees: DataFrame, sphere: float, held: Broadcast, k: int, same: bool) -> DataFrame:
    """What each task finds best for the chunk's anchors in its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(held.value, k, same)
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                if (dim := row["dim"].as_py()) not in searches:
                    continue
                _, names, search = searches[dim]
                number = {x: j for j, x in enumerate(names)}
                labels = np.array([number.get(x, -1) for x in row["labels"].as_py()])
                points = np.frombuffer(row["points"].as_buffer(), "<f8").reshape(-1, dim)
                search.offer(Tree(points, {c: row[c].values.to_numpy() for c in NODES}, sphere), row["ids"].values.to_numpy(), labels)
        for no, _, search in searches.values():
            best = search.best
            row, r = np.nonzero(np.isfinite(best.scores))
            a, w = np.divmod(row, search.windows)
            yield pa.RecordBatch.from_arrays([pa.array(no[a]), pa.array(w.astype(np.int32)), pa.array(best.ids[row, r]), pa.array(best.scores[row, r].astype(np.int64))], names=["no", "w", "other", "score"])

    return trees.select("dim", "ids", "labels", "points", *NODES).mapInArrow(run, _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("no", "w").orderBy(F.col("score").desc(), "other"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _windows_best(trees: DataFrame, many: bool, sphere: float, anchors: list[dict], k: int, same: bool, name: str) -> DataFrame:
    """(no, w, other, score, rank): each window's k best rows, stored. Bounded by the chunk."""
    context, shared = trees.sparkSession.sparkContext, []

    def scan(part: DataFrame, of: list[dict]) -> DataFrame:
        shared.append(context.broadcast(of))
        return _scan(part, sphere, shared[-1], k, same)

    if not many:
        out = stored(_best(scan(trees, anchors), k), name)
    else:
        head = stored(_best(scan(trees.where("first"), anchors), k), f"{name}_first")
        floors = {(r["no"], r["w"]): float(r["score"]) for r in head.where(F.col("rank") == k).collect()}
        raised = [a | {"floors": [floors.get((a["no"], w), -np.inf) for w in range(len(a["windows"]))]} for a in anchors]
        out = stored(_best(head.drop("rank").union(scan(trees.where("not first"), raised)), k), name)
    for held in shared:  # what they were for is stored
        held.destroy()
    return out


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, label: Column | None = None, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    A component x is floor(scale * x); a score is an integer inner product with the anchor. An anchor's positives are its
    first rows of the same label by falling score, ties by smaller id. For each, its negatives are the first rows of other
    labels with least * positive_score <= 100 * negative_score <= most * positive_score; where there is none, no row.

    Rows with a null id or label, or a vector that is null, empty or holds null or non-finite components, take no part.
    Vectors of different lengths never meet. label: by default the column of that name; any type, compared as text. Rows
    that repeat an id are candidates each and anchors each; none is a candidate of its own id. Other columns are not read.
    Scores are exact: squared norms of 2**53 and more are refused by an error.
    """
    spark = vectors.sparkSession
    rows = stored(packed(vectors, is_anchor, F.col("label") if label is None else label, scale=scale, id_col=id_col, vector_col=vector_col), "vectors")
    sphere = largest_square(rows)
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").limit(SAMPLE).collect()}
    sample = rows.orderBy(F.xxhash64("no"), "no").limit(SAMPLE).select("dim", "v").collect()
    trees = _trees(rows, sphere, _pivots(sample, sphere, sizes))
    many = trees.count() > 4 * FIRST
    anchors = rows.where("chosen")
    weight = anchors.agg(F.sum(F.length("v") + 64)).first()[0] or 0
    chunks = -(-weight // CHUNK_BYTES)
    path = scratch_path(spark, "hard_negatives")
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not chunks:
        return spark.createDataFrame([], out)
    for i in range(chunks):
        chunk = [r.asDict() | {"windows": [(-np.inf, np.inf)]} for r in anchors.where(F.pmod(F.xxhash64("no"), F.lit(chunks)) == i).select("no", "id", "label", "dim", "v").collect()]
        near = _windows_best(trees, many, sphere, chunk, positives, True, "positives")
        of: dict[int, list] = {a["no"]: [] for a in chunk}
        for r in near.orderBy("no", "rank").collect():  # bounded: the positives of a chunk
            of[r["no"]].append(r["score"])
        pulled = [a | {"windows": [(np.ceil(least * s / 100), np.floor(most * s / 100)) for s in of[a["no"]]]} for a in chunk if of[a["no"]]]
        pairs = near.select("no", (F.col("rank") - 1).alias("w"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
        if not pulled:
            pulled = [chunk[0] | {"windows": [(np.inf, -np.inf)]}] if chunk else []
        found = _windows_best(trees, many, sphere, pulled, negatives, False, "negatives") if pulled else spark.createDataFrame([], _HITS + ", rank int")
        named = found.join(pairs, ["no", "w"]).join(anchors.select("no", F.col("id").alias("anchor_id")), "no")
        named.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/chunk={i}")
    return spark.read.parquet(path).drop("chunk")
