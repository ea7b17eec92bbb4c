"""Vectors of whole-number components as rows of bytes, and the best scores that queries have met so far."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = "no bigint, id bigint, label string, chosen boolean, dim int, v binary"


def packed(vectors: DataFrame, chosen: Column, label: Column, *, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id, a label and a vector that has components, all of them finite: no (a number of the row), id, label as
    text, chosen (null: false), dim, and v, floor(scale * component) as little-endian doubles."""
    fine = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("no"), F.col(id_col).cast("bigint").alias("id"), label.cast("string").alias("label"), F.coalesce(chosen, F.lit(False)).alias("chosen"), F.when(fine, F.transform(vector_col, lambda x: x.cast("double"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.floor(x.values.to_numpy() * scale).astype("<f8") for x in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([len(x) for x in v], pa.int32()), pa.array([x.tobytes() for x in v], pa.binary())], names=[x.split()[0] for x in PACKED.split(", ")])

    return rows.where("v is not null and label is not null").mapInArrow(run, PACKED)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), dim)


def largest_square(rows: DataFrame) -> float:
    """The largest squared norm of v. Below 2**53 it bounds all sums of an inner product (Cauchy and Schwarz), which are then
    exact in doubles; anything else is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for b in batches:
            most = max([most, *(float(x @ x) for x in (np.frombuffer(v, "<f8") for v in b.column(0).to_pylist()))])
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    most = rows.select("v").mapInArrow(run, "most double").agg(F.max("most")).first()[0] or 0.0
    if not most < 2**53:
        raise ValueError("the vectors are too long for exact scores: a squared norm reaches 2**53")
    return most


class Best:
    """The k best (score, id) of n queries: by falling score, ties by smaller id."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.least = np.full(n, -np.inf) if floors is None else floors

    def floors(self, which: np.ndarray) -> np.ndarray:
        """What a score must reach to count."""
        return np.maximum(self.least[which], self.scores[..., -1][which])

    def merge(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate((query, np.repeat(touched, self.k)))
        score = np.concatenate((score, self.scores[touched].reshape(-1)))
        ident = np.concatenate((ident, self.ids[touched].reshape(-1)))
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        _, first, count = np.unique(query, return_index=True, return_counts=True)
        rank = np.arange(len(query)) - np.repeat(first, count)
        held = rank < self.k
        self.scores[query[held], rank[held]], self.ids[query[held], rank[held]] = score[held], ident[held]
