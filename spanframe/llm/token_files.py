"""Token-id files: documents in ascending id order, ids in patched frame-of-reference blocks.

A data set is a folder of Parquet files, one for each range of ids. A row is a chunk: whole consecutive documents with
about CHUNK ids together (a longer document is a chunk of its own), their index, and the packed blocks with the byte each
starts at. So a reader finds a document by part and chunk, and decodes only the blocks that hold it. Parts are ranges of
document ids: what comes before a part is the sum of the parts before, the only number that is not known while writing.
"""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pfor
from .encoder import encoder

#: ids of a chunk, about.
CHUNK = 1 << 17
#: Part tables of up to so many rows are broadcast.
BROADCAST_PARTS = 100_000


def _schema(id_type: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    fields = {"part": T.IntegerType(), "chunk": T.IntegerType(), "offset": T.LongType(), "n_ids": T.LongType(), "doc_ids": T.ArrayType(id_type), "n_tokens": longs, "block_starts": longs, "blocks": T.BinaryType()}
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _give_back() -> None:
    """Hands memory that earlier tasks of this worker process have freed back to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 2, percentile: float = pfor.PERCENTILE, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes the chunks at path, in ascending order of ids.

    Rows of one id stand in the order of their texts' hashes; null ids come first. An empty table writes no chunk.
    """
    schema = _schema(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        chunk = offset = held = 0
        ids, names, counts = [], [], []
        end = np.array([] if end_id is None else [end_id], dtype=np.uint32)

        def row() -> pa.RecordBatch:
            data, starts = pfor.encode(np.concatenate(ids) if held else np.zeros(0, np.uint32), percentile)
            values = {"part": part, "chunk": chunk, "offset": offset, "n_ids": held, "doc_ids": names, "n_tokens": counts, "block_starts": starts, "blocks": data}
            return pa.RecordBatch.from_pylist([values], schema=target)

        target = None
        for b in batches:
            if target is None:
                longs = pa.list_(pa.int64())
                target = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("offset", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(b.schema.field(0).type)), ("n_tokens", longs), ("block_starts", longs), ("blocks", pa.binary())])
            for name, text in zip(b.column(0), b.column(1), strict=True):
                now = np.concatenate((code.encode(text.as_py()), end))
                if held and held + len(now) > CHUNK:
                    yield row()
                    chunk, offset, held = chunk + 1, offset + held, 0
                    ids, names, counts = [], [], []
                ids.append(now)
                names.append(name.as_py())
                counts.append(len(now))
                held += len(now)
        if names:
            yield row()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = (F.col("id"), F.xxhash64("text"))  # both deal out the ranges too, so that one id, or none, is not one task
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, schema).write.parquet(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks with start: how many ids all chunks before hold."""
    chunks = spark.read.parquet(path)
    parts = chunks.groupBy(F.col("part").alias("p")).agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("p", before.alias("before"))
    if chunks.select("part").distinct().count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    return chunks.join(parts, F.col("part") == F.col("p")).withColumn("start", F.col("before") + F.col("offset")).drop("p", "before", "offset", "n_ids")


def _read(spark: SparkSession, path: str, field: T.StructField, make) -> DataFrame:
    chunks = _chunks(spark, path).select("doc_ids", "start", "n_tokens", "block_starts", "blocks")
    id_type = chunks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                names, n = b.column(0)[i].values, b.column(2)[i].values.to_numpy()
                values = pfor.decode(b.column(4)[i].as_buffer(), b.column(3)[i].as_py())
                ends = np.cumsum(n)
                begins = ends - n
                made = pa.array([make(values[s:e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([names, pa.array(begins + b.column(1)[i].as_py()), pa.array(n), made], names=schema.names)

    return chunks.mapInArrow(run, schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document of the files."""
    return _read(spark, path, T.StructField("ids", T.ArrayType(T.LongType())), lambda ids: ids.astype(np.int64))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone; the checksum is over little-endian u32."""
    return _read(spark, path, T.StructField("ids_crc32", T.LongType()), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
