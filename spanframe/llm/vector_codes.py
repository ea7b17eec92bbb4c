"""Vector codes: each part of a vector by the number of its codebook's nearest entry, trained and coded exactly in integers.

Components become integers. A block of vectors is stored as, for each dimension, the dictionary of its distinct integers and
each vector's number in it. An assignment tabulates, for each dimension, the squared differences of every distinct integer
to all entries once; a part's distances to the entries are then gathered from these tables by the stored numbers and added.
Codebooks move by sums and counts of a block's parts, which Spark adds up; they are bounded by their parameters (entries x
dimensions), and only they pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import join_heavy, stored

#: Vectors of a block at most, and components of a block at most (a longer vector is a block of its own).
BLOCK, BLOCK_COMPONENTS = 8192, 1 << 22
#: Entries of a table of squared differences that are held at once.
GATHER = 1 << 21
#: Integers beyond this are refused, so that sums stay exact.
LARGEST = 1 << 62


@dataclass(frozen=True)
class Codebooks:
    """entries[part][entry]: a tuple of integers; all of a part have its length."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and position within the part, comma-joined."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def _edges(dim: int, parts: int) -> list[int]:
    """Where parts begin and end; equal parts where dim allows, else parts whose lengths differ by one."""
    return [p * dim // parts for p in range(parts + 1)]


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    fine = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    large = F.exists(vector_col, lambda x: F.abs(x.cast("double") * scale) >= float(LARGEST))
    checked = F.when(large, F.raise_error(F.lit("a component is too large for exact codes")).cast("array<double>")).otherwise(ints)
    return vectors.where(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), checked.alias("v"))


def _pack(x: np.ndarray) -> tuple[list[float], list[int], bytes]:
    """The dimensions' dictionaries one behind the other, their sizes, and the vectors' numbers, dimension by dimension."""
    values, sizes, numbers = [], [], []
    for column in x.T:
        distinct, number = np.unique(column, return_inverse=True)
        values.append(distinct)
        sizes.append(len(distinct))
        numbers.append(number.astype("<u2"))
    return np.concatenate(values).tolist() if values else [], sizes, b"".join(n.tobytes() for n in numbers)


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of vectors of equal length (dim): ids, labels, and the dictionaries and numbers of _pack."""
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("numbers", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        count: dict[int, int] = {}

        def block(dim: int) -> pa.RecordBatch:
            got = pa.Table.from_batches(held.pop(dim)).combine_chunks()
            count.pop(dim)
            flat = got["v"].combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            values, sizes, numbers = _pack(flat.flatten().to_numpy().reshape(got.num_rows, dim))
            lists = [pa.array([got[c].to_pylist()], pa.list_(got.schema.field(c).type)) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *lists, pa.array([values], pa.list_(pa.float64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([numbers], pa.binary())], names=schema.names)

        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                same = b.filter(pa.array(lengths == dim))
                most = max(1, min(BLOCK, BLOCK_COMPONENTS // max(dim, 1)))
                at = 0
                while at < same.num_rows:
                    take = min(same.num_rows - at, most - count.get(dim, 0))
                    held.setdefault(dim, []).append(same.slice(at, take))
                    count[dim] = count.get(dim, 0) + take
                    at += take
                    if count[dim] == most:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, schema)


class _Block:
    """One stored block, ready to be assigned."""

    def __init__(self, row: dict):
        self.dim, self.n = row["dim"], len(row["ids"])
        ends = np.cumsum([0, *row["sizes"]])
        values = np.array(row["values"])
        self.values = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.numbers = np.frombuffer(row["numbers"], dtype="<u2").reshape(self.dim, self.n) if self.dim else np.zeros((0, self.n), np.uint16)

    def _kind(self, books: Codebooks) -> type:
        """64-bit integers where no sum of squared differences can leave them, else Python's."""
        most = max((float(np.abs(v).max()) for v in self.values if len(v)), default=0.0)
        reach = most + max((abs(x) for part in books.entries for e in part for x in e), default=0)
        return np.int64 if reach**2 * max(self.dim, 1) < 2**62 else object

    def integers(self, d: int, kind: type) -> np.ndarray:
        return self.values[d].astype(np.int64) if kind is np.int64 else np.array([int(x) for x in self.values[d]], dtype=object)

    def assign(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) by part and vector: the nearest entry, of equals the first."""
        kind, edges = self._kind(books), _edges(self.dim, len(books.entries))
        codes = np.zeros((len(books.entries), self.n), np.int64)
        errors = np.zeros((len(books.entries), self.n), kind)
        for p, entries in enumerate(books.entries):
            table = [np.subtract.outer(self.integers(d, kind), np.array([e[d - edges[p]] for e in entries], dtype=kind)) ** 2 for d in range(edges[p], edges[p + 1])]
            step = max(1, GATHER // len(entries))
            for at in range(0, self.n, step):
                part = slice(at, at + step)
                far = np.zeros((min(step, self.n - at), len(entries)), kind)
                for squares, d in zip(table, range(edges[p], edges[p + 1]), strict=True):
                    far += squares[self.numbers[d, part]]
                codes[p, part] = best = far.argmin(axis=1)
                errors[p, part] = far[np.arange(len(far)), best]
        return codes, errors

    def sums(self, codes: np.ndarray, entries: int, into: dict) -> None:
        """Adds each entry's count and component sums: into[(part, entry)] = [count, sums]."""
        edges = _edges(self.dim, len(codes))
        for p, code in enumerate(codes):
            seen = np.bincount(code, minlength=entries)
            totals = []
            for d in range(edges[p], edges[p + 1]):
                # how often an entry met each distinct integer, times the integer: exact for integers of any size
                met = np.bincount(code * len(self.values[d]) + self.numbers[d], minlength=entries * len(self.values[d])).reshape(entries, -1)
                small = max(abs(self.values[d][0]), abs(self.values[d][-1])) * self.n < 2**62
                totals.append(met @ self.integers(d, np.int64) if small else met.astype(object) @ self.integers(d, object))
            for e in np.flatnonzero(seen).tolist():
                held = into.setdefault((p, e), [0, [0] * len(totals)])
                held[0] += int(seen[e])
                for i, t in enumerate(totals):
                    held[1][i] += int(t[e])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _moved(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floor of its parts' means; unused entries stay."""
    entries = len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[tuple[int, int], list] = {}
        for row in _each(batches):
            block = _Block(row)
            block.sums(block.assign(books)[0], entries, into)
        flat = [(p, e, i, n, str(x)) for (p, e), (n, sums) in into.items() for i, x in enumerate(sums)]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["part", "entry", "i", "n", "s"])

    found = blocks.mapInArrow(run, "part int, entry int, i int, n bigint, s string").groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = {(r["part"], r["entry"], r["i"]): int(r["s"]) // r["n"] for r in found.collect()}  # bounded: entries x dimensions
    return Codebooks(tuple(tuple(tuple(new.get((p, e, i), x) for i, x in enumerate(entry)) for e, entry in enumerate(part)) for p, part in enumerate(books.entries)))


def compress(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, dim: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(<id_col>, <label_col>, codes array<int> by part, error bigint) of every kept row; and the codebooks.

    A component x is floor(scale * x). Codebooks start as the parts of the rows of the smallest ids, of equal ids by their
    vectors, null ids last; fewer rows give fewer entries. Each of rounds assigns all parts and moves the entries; then all are
    assigned again.

    Rows whose vector is null or holds null or non-finite components are dropped. So are vectors of another length than dim,
    which is by default the most frequent one (of equals the shortest). Rows of null or repeated ids are rows of their own.
    Where dim is no multiple of parts, parts differ by one component in length; without components all codes are 0. Without
    rows the result is empty and there are no codebooks. Other columns are not read. Integers of 2**62 and more, and an
    error beyond 64 bits, are refused by an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    rows = _kept(vectors, id_col, vector_col, label_col, scale)
    schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField(label_col, vectors.schema[label_col].dataType), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    blocks = stored(_blocks(rows), "vector_blocks")
    if dim is None:
        first = blocks.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.col("n").desc(), "dim").first()
        if first is None:
            return vectors.sparkSession.createDataFrame([], schema), None
        dim = first["dim"]
    blocks = blocks.where(F.col("dim") == dim)
    start = [[int(x) for x in r["v"]] for r in rows.where(F.size("v") == dim).select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not start:
        return vectors.sparkSession.createDataFrame([], schema), None
    edges = _edges(dim, parts)
    books = Codebooks(tuple(tuple(tuple(v[a:b]) for v in start) for a, b in zip(edges[:-1], edges[1:], strict=True)))
    for _ in range(rounds):
        books = _moved(blocks, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                block = _Block(one.select(["dim", "ids", "values", "sizes", "numbers"]).to_pylist()[0])
                codes, errors = block.assign(books)
                ends = pa.array(np.arange(0, codes.size + 1, len(codes), dtype=np.int32))
                flat = pa.array(codes.T.reshape(-1).astype(np.int32))
                total = errors.sum(axis=0)
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), pa.ListArray.from_arrays(ends, flat), pa.array(total.tolist(), pa.int64())], names=schema.names)

    return blocks.mapInArrow(run, schema), books


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error: the errors summed over all rows of its label, null labels together. A label of very many rows
    meets its sum by a broadcast."""
    rows = coded.withColumns({"__label": F.coalesce(F.col(label_col).cast("string"), F.lit("")), "__none": F.col(label_col).isNull()})
    sums = rows.groupBy("__label", "__none").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    return join_heavy(rows, sums, ["__label", "__none"], "__n").drop("__label", "__none")


def code_text(codes: str = "codes"):
    """Codes as text, two lower-case hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c.cast("bigint")), 2, "0"))), "")
