"""Language identification by rank-order profiles of letter n-grams.

A profile is the RANKS most frequent n-grams (one to three letters, words bordered by a blank) of a language's training
texts, by rank. A document is compared by its own most frequent n-grams: each costs the difference of its ranks, or RANKS
where the profile lacks it (the out-of-place distance); the language of the least sum is predicted.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import stored

#: n-grams of a profile.
RANKS = 300
#: Profiles go to the tasks in blocks of so many languages, RANKS numbers each.
BLOCK_LANGUAGES = 1_000
#: A task's counts of grams are handed on when there are so many.
MOST_HELD = 2_000_000
UNKNOWN = "und"
#: Letters of a text that are cut into grams together.
PIECE = 1 << 20
_BITS = np.uint64(21)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(code: np.ndarray) -> np.ndarray:
    """n-grams of a stretch of letters (0: a blank) that start behind its first one and end before its last, as numbers."""
    one, two, three = code[:-2], code[1:-1], code[2:]
    pairs = ((one << _BITS) | two)[(one > 0) | (two > 0)]
    triples = ((one << (_BITS + _BITS)) | (two << _BITS) | three)[two > 0]
    # a leading mark keeps grams of different lengths apart: blanks are 0
    return np.concatenate((two[two > 0] | np.uint64(1 << 62), pairs | np.uint64(1 << 63), triples))


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of one to three letters as numbers, and how often each stands; blanks stand only at a gram's ends. A text
    is taken in pieces of PIECE letters, each seen with its neighbours, so memory grows with a text's distinct grams alone."""
    low, found = (text or "").lower(), []
    for at in range(0, len(low) + 1 if low else 0, PIECE):
        # one blank before the text, and two behind it: the last word's end is a place of its own
        here = low[max(at - 1, 0) : at + PIECE + 1]
        code = np.frombuffer(here.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = np.where(_letters()[code], code, 0).astype(np.uint64)
        ahead, behind = at == 0, max(0, at + PIECE + 1 - len(low)) if at + PIECE >= len(low) else 0
        found.append(np.unique(_grams(np.concatenate((np.zeros(int(ahead), np.uint64), code, np.zeros(min(behind, 2), np.uint64)))), return_counts=True))
        if len(found) > 1:
            found = [_added(found)]
    return found[0] if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    counts = np.zeros(len(names), np.int64)
    np.add.at(counts, where, np.concatenate([x for _, x in found]))
    return names, counts


def gram_text(gram: int) -> str:
    """How a gram's number reads, with _ for blanks."""
    gram &= (1 << 64) - 1
    n = 1 if gram >> 62 == 1 else 2 if gram >> 63 else 3
    return "".join(chr(c) if (c := gram >> (21 * i) & 0x1FFFFF) else "_" for i in range(n - 1, -1, -1))


def _most_frequent(found: tuple[np.ndarray, np.ndarray], ranks: int) -> np.ndarray:
    names, counts = found
    return names[np.argsort(-counts, kind="stable")[:ranks]]


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS) -> DataFrame:
    """(lang, gram, n, rank) from the rows with a language: counts over whole texts, ties by the gram's number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                found.setdefault(lang.as_py(), []).append(now := gram_counts(text.as_py()))
                size += len(now[0])
                if size > MOST_HELD:
                    yield from counted(found)
                    found, size = {}, 0
        yield from counted(found)

    def counted(found: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in found.items():
            names, counts = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= ranks)


class Classifier:
    """Profiles as one table: row i of ranks holds gram i's rank in each language, or RANKS."""

    def __init__(self, profiles: list[tuple[str, int, int]], ranks: int = RANKS):
        self.languages = sorted({lang for lang, _, _ in profiles})
        self.most = ranks
        number = {lang: i for i, lang in enumerate(self.languages)}
        self.grams = np.unique(np.array([g & (1 << 64) - 1 for _, g, _ in profiles], dtype=np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), ranks, dtype=np.int32)
        for lang, gram, rank in profiles:
            self.ranks[np.searchsorted(self.grams, np.uint64(gram & (1 << 64) - 1)), number[lang]] = rank - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - distance / greatest distance; ties go to the smaller name."""
        top = _most_frequent(gram_counts(text), self.most)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = self.grams[at] == top
        ranks = self.ranks[np.where(known, at, len(self.grams))]
        off = np.where(ranks == self.most, self.most, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(off))
        return self.languages[best], 1.0 - float(off[best]) / (self.most * len(top))


def identify_languages(docs: DataFrame, learn_from: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predicts the language of every row's whole text from profiles of the rows where learn_from holds.

    Returns a row for each row of docs: <id_col>, the columns in keep, lang_pred (a learned language; 'und' for texts that
    are null or have no letter, or if nothing was learned) and score (0 to 1). Of languages at the same distance the smaller
    name is predicted. Rows of null language, or where learn_from is null, teach nothing; only text_col is used for a
    prediction. Very long texts are counted in pieces, whole. Copies and rows of null or repeated ids count as often as they stand, each with its own prediction. An empty
    table gives an empty result. Other columns are not read.
    """
    own = ["__id", *(f"__{i}" for i in range(len(keep)))]
    rows = docs.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text"))
    context = docs.sparkSession.sparkContext
    blocks = _blocks(learn_profiles(docs.where(learn_from), text_col, lang_col, ranks), ranks)
    block, more = next(blocks, Classifier([], ranks)), next(blocks, None)
    if more is None:
        out = _scored(rows, context.broadcast(block), own)
    else:
        rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        passes = []
        for b in itertools.chain((block, more), blocks):
            shared = context.broadcast(b)
            passes.append(stored(_scored(rows, shared, ["__row"]), "scored"))
            shared.destroy()
        best = reduce(DataFrame.union, passes).groupBy("__row").agg(F.min(F.struct((-F.col("score")).alias("off"), "lang_pred")).alias("best"))
        out = rows.join(best, "__row").select(*own, F.col("best.lang_pred").alias("lang_pred"), (-F.col("best.off")).alias("score"))
    return out.select(F.col("__id").alias(id_col), *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")


def _blocks(profiles: DataFrame, ranks: int) -> Iterator[Classifier]:
    """Classifiers of up to BLOCK_LANGUAGES languages each; one is on the driver at a time."""
    names, block = set(), []
    for lang, gram, rank in stored(profiles.select("lang", "gram", "rank"), "profiles").orderBy("lang", "rank").toLocalIterator():
        if lang not in names and len(names) == BLOCK_LANGUAGES:
            yield Classifier(block, ranks)
            names, block = set(), []
        names.add(lang)
        block.append((lang, gram, rank))
    if block:
        yield Classifier(block, ranks)


def _scored(rows: DataFrame, shared: Broadcast, keep: list[str]) -> DataFrame:
    """rows(the columns in keep, __text) -> (keep, lang_pred, score) by the classifier in shared."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shared.value.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            columns = [*b.columns[:-1], pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(*keep, "__text").mapInArrow(run, schema)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % n
