"""Benchmark decontamination: an FM-index of each shard of documents, searched for all windows of the test phrases.

A task reads its documents in shards of about SHARD_WORDS words (at least one whole document), indexes a shard, runs the
backward search of all windows over it at once, locates the occurrences, and merges them into removal spans. A benchmark of
up to BLOCK_WORDS words is one block of windows, and nothing is shuffled. A larger one takes a pass for each block: a block
is broadcast, the documents that it hits are stored by the number of their row, and the broadcast is destroyed before the
next; the hits of all passes are merged by row in the end. So there is never more than one block on the driver or a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import stored
from .fm_index import FMIndex

#: Words of a window; shorter items are one window.
WINDOW = 13
SHARD_WORDS = 400_000
BLOCK_WORDS = 1_000_000
_WORDS = bytes((i + 32 if 65 <= i <= 90 else i) if 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = (T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType())))
CUT = T.StructField("cut", T.StringType())
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Phrases:
    """The windows of a block of items, as numbers in a vocabulary of their own."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], list[int]] = {}
        self.names = [name for name, _ in items]
        for number, (_, words) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for at in range(max(1, len(ids) - window + 1)):
                windows.setdefault(tuple(ids[at : at + window]), []).append(number)
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.windows = np.zeros((len(windows), window), dtype=np.int64)
        for row, w in enumerate(windows):
            self.windows[row, window - len(w) :] = w
        self.items = [sorted(set(x)) for x in windows.values()]


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans, touching ones joined."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], True)].tolist(), strict=True))


def _search(shard: list[list[bytes]], phrases: Phrases) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """(document's place in the shard, its spans in words, its items) for those with a hit."""
    bounds = np.cumsum([0] + [len(w) + 1 for w in shard])
    text = np.zeros(int(bounds[-1]), dtype=np.int64)
    get = phrases.vocabulary.get
    for at, words in zip(bounds[:-1].tolist(), shard, strict=True):
        text[at : at + len(words)] = np.fromiter(map(get, words, itertools.repeat(0)), dtype=np.int64, count=len(words))
    index = FMIndex(text, len(phrases.vocabulary))
    found, lo, hi = index.search(phrases.windows, phrases.lengths)
    if not len(found):
        return
    which = np.repeat(found, hi - lo)
    rows = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange(len(which))
    at = index.locate(rows)
    doc = np.searchsorted(bounds, at, side="right") - 1
    order = np.argsort(doc, kind="stable")
    doc, at, which = doc[order], at[order], which[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for a, w, d in zip(np.split(at, cuts), np.split(which, cuts), doc[np.concatenate(([0], cuts))].tolist(), strict=True):
        start = a - bounds[d]
        items = sorted({i for x in np.unique(w).tolist() for i in phrases.items[x]})
        yield d, _merge(start, start + phrases.lengths[w]), [name for i in items if (name := phrases.names[i]) is not None]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    """Blocks of at most BLOCK_WORDS words; only one is on the driver at a time. An item alone may be larger."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator()
    for name, text in rows:
        words = words_of(text)
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield Phrases(block, window)
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    if block:
        yield Phrases(block, window)


def _scan(rows: DataFrame, shared: Broadcast, keep: list[str], cut: bool = False, hits_only: bool = False) -> DataFrame:
    """rows(the columns in keep, __text) -> (keep, n_words, spans, items, with cut the text without the spans) by the block of
    windows in shared."""
    schema = T.StructType([*(rows.schema[c] for c in keep), *RESULT, *([CUT] if cut else [])])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for b in batches:
            texts, counts, shard, first, size = b.column(k), [], [], 0, 0
            spans: list[list[dict[str, int]]] = [[] for _ in range(b.num_rows)]
            items: list[list[str]] = [[] for _ in range(b.num_rows)]
            for row in range(b.num_rows + 1):
                if row == b.num_rows or size >= SHARD_WORDS:
                    for d, s, names in _search(shard, phrases) if shard and len(phrases.windows) else ():
                        spans[first + d] = [{"start": x, "end": y} for x, y in s]
                        items[first + d] = sorted(set(names))
                    shard, first, size = [], row, 0
                if row < b.num_rows:
                    words = words_of(texts[row].as_py())
                    shard.append(words)
                    counts.append(len(words))
                    size += len(words)
            out = pa.RecordBatch.from_arrays([*b.columns[:k], *_result(texts, counts, spans, items, cut)], names=schema.names)
            yield out.filter(pa.array([bool(x) for x in spans])) if hits_only else out

    return rows.select(*keep, "__text").mapInArrow(run, schema)


def _result(texts: pa.Array, counts: list[int], spans: list[list[dict[str, int]]], items: list[list[str]], cut: bool) -> list[pa.Array]:
    left = [pa.array([remove_spans(t.as_py(), [(x["start"], x["end"]) for x in s]) if s else t.as_py() for t, s in zip(texts, spans, strict=True)], pa.string())] if cut else []
    return [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), *left]


def _merged(rows: DataFrame, keep: list[str], cut: bool) -> DataFrame:
    """rows(keep, __text, found: the spans of all passes, items) -> as _scan."""
    schema = T.StructType([*(rows.schema[c] for c in keep), *RESULT, *([CUT] if cut else [])])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [len(words_of(t.as_py())) for t in b.column(k)]
            spans = []
            for found in b.column(k + 1).to_pylist():
                every = np.array([(x["start"], x["end"]) for x in found or ()], dtype=np.int64).reshape(-1, 2)
                spans.append([{"start": x, "end": y} for x, y in _merge(every[:, 0], every[:, 1])] if len(every) else [])
            items = [sorted(set(x or ())) for x in b.column(k + 2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *_result(b.column(k), counts, spans, items, cut)], names=schema.names)

    return rows.select(*keep, "__text", "found", "items").mapInArrow(run, schema)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), cut: bool = False) -> DataFrame:
    """Removal spans of every document: where any window of a test item occurs.

    Returns a row for each row of docs: <id_col>, the columns in keep, n_words, spans (disjoint, by words, half-open,
    touching ones merged) and items (ids as strings of all items with an occurring window, distinct). Null or empty texts
    have no words; items of null text are ignored, and those of null id count in spans, not in items; items of fewer words than the window are one window; repeated items and rows,
    several texts of one id and null ids stand for themselves. With an empty benchmark every document has no spans. With cut,
    the column cut is the text without the spans' words (the text itself where there is no span).
    """
    context = docs.sparkSession.sparkContext
    own = ["__id", *(f"__keep_{c}" for c in keep)]
    rows = docs.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__keep_{c}") for c in keep), F.col(text_col).alias("__text"))
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    block, more = next(blocks, Phrases([], window)), next(blocks, None)
    if more is None:
        out = _scan(rows, context.broadcast(block), own, cut)
    else:
        rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        hits = []
        for b in itertools.chain((block, more), blocks):
            shared = context.broadcast(b)
            hits.append(stored(_scan(rows, shared, ["__row"], hits_only=True), "hits"))
            shared.destroy()
        found = reduce(DataFrame.union, hits).groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("found"), F.flatten(F.collect_list("items")).alias("items"))
        out = _merged(rows.join(found, "__row", "left"), own, cut)
    return out.select(F.col("__id").alias(id_col), *(F.col(f"__keep_{c}").alias(c) for c in keep), "n_words", "spans", "items", *(["cut"] if cut else []))


def contamination(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """The spans of contaminated_spans with n_hit (words in a span), n_items, items_sha256 (of the sorted ids, joined by
    commas) and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    out = contaminated_spans(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    out = out.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("bigint"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def remove_spans(text: str | None, spans: list[tuple[int, int]], gap: str = " ") -> str | None:
    """text without the words of the spans (word numbers, half-open); what stands between words of one span goes too."""
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    mask = np.frombuffer(data.translate(_WORDS), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : begin[s]])
        at = int(end[e - 1])
    return gap.join(x.decode("utf-8", "surrogatepass").strip(" ") for x in [*out, data[at:]])
