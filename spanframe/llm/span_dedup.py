"""Substring dedup by sliding sentence spans.

A text's units are its sentences; one of more than WORDS words is cut into pieces by its content: a piece begins at a word whose
hash is the least among its neighbours, up to a quarter of WORDS to each side, so that pieces have half of WORDS words on average, and a
passage inside of another long sentence is cut alike but for its ends. A run is any number of consecutive units with units of
SENTENCES sentences and LEAST words, or two units and WORDS words, at least. The
units that any repeated run covers are removed wherever it is not the first: the first is in the smallest document id, and
there at the first place. Hashed (with every) are only the shortest run from each unit and the shortest run up to each unit:
of a longer run's units, each is in the shortest run from it or in the shortest up to the run's end, and those repeat with
it. Hashes are 128 bits, so equal hashes are equal runs. Runs meet in one shuffle by hash; those that a sample of the runs
shows to be very frequent (the HEAVY_RUNS most frequent at most, so that any other is at most one in HEAVY_RUNS of all) are left out
of it, combined where they are, and held against a broadcast of their first places. So
the sample changes the way, not the result, and no task gathers a frequent run's places.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import split_repeats, stored

SENTENCES, LEAST, WORDS = 3, 10, 25
#: A run that stands more often than HEAVY times, by a sample of this share of all runs, is frequent; at most so many are.
SAMPLE, HEAVY, HEAVY_RUNS = 0.01, 10_000, 50_000
#: Sentences end at a line break, at a full stop, question or exclamation mark before white space, and at a stop of a script
#: that needs no white space after it.
_CUT = re.compile(r"(?<=[.!?])(?=\s)|\n")
_STOPS = "。｡！？।॥።។။"
_WIDE_CUT = re.compile(rf"(?<=[.!?؟۔])(?=\s)|(?<=[{_STOPS}])(?![{_STOPS}])|\n")
#: Where words are not spaced, two characters of Chinese or Japanese, or four of Thai, Lao, Burmese or Khmer, count as a word.
_EAST, _SOUTH = "\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff", "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_UNSPACED = re.compile(f"[{_EAST}{_SOUTH}]")
_WIDE_WORD = re.compile(rf"[{_EAST}]{{1,2}}|[{_SOUTH}]{{1,4}}|[^\s{_EAST}{_SOUTH}]+")
_WORD = re.compile(r"\S+")


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Character ranges of the sentences, without the white space around them."""
    out, at = [], 0
    ends = [m.span() for m in (_CUT if text.isascii() else _WIDE_CUT).finditer(text)]
    for a, b in [*ends, (len(text), len(text))]:
        said = text[at:a]
        if bare := said.strip():
            start = at + len(said) - len(said.lstrip())
            out.append((start, start + len(bare)))
        at = b
    return out


_MOST = np.iinfo(np.uint64).max


def _starts(words: list[str], reach: int, most: int) -> list[int]:
    """Where pieces begin: at the first word, and at words whose hash is below those of the reach words before, and at most those
    of the reach words behind. A piece of more than most words is cut where its hash is least, but for reach words at its ends."""
    n = len(words)
    h = np.full(n + 2 * reach, _MOST, dtype=np.uint64)
    h[reach : reach + n] = list(map(xxhash.xxh64_intdigest, words))
    before, behind = h[:n].copy(), h[reach + 1 : reach + 1 + n].copy()
    for k in range(1, reach):
        np.minimum(before, h[k : k + n], out=before)
        np.minimum(behind, h[reach + 1 + k : reach + 1 + k + n], out=behind)
    h = h[reach : reach + n]
    found = np.flatnonzero((h < before) & (h <= behind))
    todo, out = [(a, b) for a, b in itertools.pairwise([0, *(i for i in found.tolist() if i), len(h)])], []
    while todo:
        a, b = todo.pop()
        if b - a > most:
            cut = a + reach + int(h[a + reach : b - reach].argmin())
            todo += [(a, cut), (cut, b)]
        else:
            out.append(a)
    return sorted(out)


def units_of(text: str, words: int = WORDS) -> list[tuple[int, int, int, int]]:
    """(start, end, words, sentence) of the sentences, or of the pieces of those that have more than so many words."""
    word = _WIDE_WORD if not text.isascii() and _UNSPACED.search(text) else None
    out = []
    for k, (a, b) in enumerate(sentences_of(text)):
        n = len(word.findall(text, a, b)) if word else len(text[a:b].split())
        if n <= words:
            out.append((a, b, n, k))
            continue
        places = [m.span() for m in (word or _WORD).finditer(text, a, b)]
        starts = _starts([text[i:j] for i, j in places], max(1, (words + 1) // 4), words)
        out += [(places[i][0], places[j - 1][1], j - i, k) for i, j in zip(starts, [*starts[1:], len(places)], strict=True)]
    return out


def _ends(units: list[tuple[int, int, int, int]], sentences: int, least: int, words: int) -> list[int]:
    """Where the shortest run from each unit ends; too far where there is none."""
    out, end, total = [], 0, 0
    for i, (_, _, size, k) in enumerate(units):
        while end <= len(units) and not (end - i >= 2 and (total >= words or units[end - 1][3] - k + 1 >= sentences and total >= least)):
            total += units[end][2] if end < len(units) else 0
            end += 1
        out.append(end)
        total -= size
    return out


def runs_of(text: str, sentences: int = SENTENCES, least: int = LEAST, words: int = WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first unit, number of units, hash) of the shortest run from every unit."""
    return (r for r, ahead in _runs(text, sentences, least, words) if ahead)


def all_runs_of(text: str, sentences: int = SENTENCES, least: int = LEAST, words: int = WORDS) -> Iterator[tuple[int, int, bytes]]:
    """runs_of, and the shortest run up to every unit where that is another; in the order of their first units."""
    return (r for r, _ in _runs(text, sentences, least, words))


def _runs(text: str, sentences: int, least: int, words: int) -> Iterator[tuple[tuple[int, int, bytes], bool]]:
    units = units_of(text, words)
    hashes = [xxhash.xxh3_128_digest(" ".join(text[a:b].split())) for a, b, _, _ in units]
    ends = _ends(units, sentences, least, words)
    for i, end in enumerate(ends):
        if end > len(units):
            break
        yield (i, end - i, xxhash.xxh3_128_digest(b"".join(hashes[i:end]))), True
        # No run from a unit ends between this end and the next: the shortest runs up to there start here, too.
        for far in range(end + 1, min(ends[i + 1] if i + 1 < len(ends) else end, len(units) + 1)):
            yield (i, far - i, xxhash.xxh3_128_digest(b"".join(hashes[i:far]))), False


def _runs_of_rows(docs: DataFrame, id_col: str, text_col: str, every: bool, sizes: tuple[int, int, int]) -> DataFrame:
    """(id, mark, at, n, h, g) of every hashed run; mark tells rows of one id with other texts apart."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("mark", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("g", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, n, digests = [], [], [], []
            for row, text in enumerate(b.column(2)):
                for i, k, digest in (all_runs_of if every else runs_of)(text.as_py(), *sizes):
                    rows.append(row)
                    at.append(i)
                    n.append(k)
                    digests.append(digest)
                    if len(rows) >= 200_000:
                        yield flush(b, rows, at, n, digests)
                        rows, at, n, digests = [], [], [], []
            yield flush(b, rows, at, n, digests)

    def flush(b: pa.RecordBatch, rows: list[int], at: list[int], n: list[int], digests: list[bytes]) -> pa.RecordBatch:
        pick = pa.array(rows, pa.int32())
        h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=schema.names)

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, least: int = LEAST, words: int = WORDS, every: bool = False) -> DataFrame:
    """(id, mark, at, n): the runs that are not the first of their kind, by id (null last), mark and place."""
    runs = stored(_runs_of_rows(docs, id_col, text_col, every, (sentences, least, words)), "runs")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark", "at")
    seen = runs.sample(SAMPLE, 7).groupBy("h", "g").agg(F.count("*").alias("n"))
    heavy = seen.orderBy(F.col("n").desc(), "h", "g").limit(HEAVY_RUNS).where(F.col("n") > HEAVY * SAMPLE).select("h", "g")
    heavy = F.broadcast(stored(heavy, "frequent"))
    light = runs.join(heavy, ["h", "g"], "left_anti").withColumn("first", F.min(place).over(Window.partitionBy("h", "g")))
    hot = runs.join(heavy, ["h", "g"], "left_semi")
    firsts = hot.groupBy("h", "g").agg(F.min(place).alias("first"))
    later = light.select("id", "mark", "at", "n", "first").union(hot.join(F.broadcast(firsts), ["h", "g"]).select("id", "mark", "at", "n", "first"))
    return later.where(place != F.col("first")).select("id", "mark", "at", "n")


def cut_sentences(text: str, runs: list[tuple[int, int]], words: int = WORDS) -> tuple[str, int]:
    """text without the units of the runs, and of how many sentences something went; what stands between two units goes with the first."""
    places = units_of(text, words)
    gone = np.zeros(len(places) + 1, dtype=np.int64)
    for at, n in runs:
        gone[at] += 1
        gone[at + n] -= 1
    gone = np.flatnonzero(np.cumsum(gone[:-1]) > 0).tolist()
    out, at = [], 0
    for i in gone:
        out.append(text[at : places[i][0]])
        at = places[i + 1][0] if i + 1 < len(places) else len(text)
    return "".join([*out, text[at:]]), len({places[i][3] for i in gone})


def dedup_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), every: bool = False, **options: int) -> DataFrame:
    """Every document without its repeated sentences and pieces of long sentences.

    Returns a row for each row of docs: <id_col>, the columns in keep, n_sentences, n_removed (of how many sentences all or
    a piece went), and text (null for null). Documents of one sentence have no run and stay, unless it is cut into pieces.
    Without every, only the shortest run from each unit counts, so that the last units of a passage may stay. Runs of fewer
    words than LEAST never go. Null ids are the last; different texts of one id are documents of their own, in the order of
    their texts' hashes; of rows of one id and text (or of no id and one text) all but one lose all of their runs. Runs that repeat
    inside a document are removed after the first. Other columns are not read; an empty table gives an empty result.
    """
    docs, copies = split_repeats(docs.select(*dict.fromkeys((id_col, *keep, text_col))), id_col, text_col)
    cut = repeated_runs(docs, id_col=id_col, text_col=text_col, every=every, **options).distinct()
    cut = cut.groupBy("id", "mark").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    cut = cut.select(F.col("id").alias("__id2"), F.col("mark").alias("__mark2"), "runs")
    rows = docs.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__mark"))
    rows = rows.join(cut, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__mark") == F.col("__mark2")), "left").drop("__id2", "__mark2", "__mark")
    sizes = (options.get("sentences", SENTENCES), options.get("least", LEAST), options.get("words", WORDS))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in ("__text", "runs")), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])

    def clean(batches: Iterator[pa.RecordBatch], copied: bool = False) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text, runs in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                said = text.as_py()
                cut = [(r["at"], r["n"]) for r in runs.as_py() or ()]
                if copied and said is not None:
                    cut = [r[:2] for r in (all_runs_of if every else runs_of)(said, *sizes)]
                left, gone = cut_sentences(said, cut, sizes[2]) if cut else (said, 0)
                made.append((len(sentences_of(said or "")), gone, left))
            n, gone, left = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=schema.names)

    out = rows.mapInArrow(clean, schema)
    if copies is not None:
        more = copies.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text"), F.lit(None).cast(rows.schema["runs"].dataType).alias("runs"))
        out = out.union(more.mapInArrow(lambda batches: clean(batches, True), schema))
    return out.select(F.col("__id").alias(id_col), *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), "n_sentences", "n_removed", "text")
