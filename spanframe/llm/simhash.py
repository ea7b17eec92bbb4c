"""SimHash near-duplicate groups, with candidates by pigeonring chains.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most 3 bits, then some segment
starts a chain along the ring whose first 1, 2, 3, 4 segments differ in at most 0, 1, 2, 3 bits together (the budgets
l * 3 / 4, rounded down). Chains of length 2 are the join key: a start, its segment, and the next segment up to one bit.
Next segments that are equal meet by themselves; for those that differ in one bit, segments of even parity give themselves
and segments of odd parity give their 16 neighbours (all even), and only unlike parities are compared. Pairs that meet are tested for chains of length 3, and
then for the full distance. No pair is lost, and none is written: a bucket returns a spanning forest of its links.

Buckets of more than HOT fingerprints go on to a longer chain first: what is left of the ring differs in at most 3 bits, so
one of its four bytes is equal, and the bucket is dealt by byte. Only buckets that stay hot are compared in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import join_heavy, stored
from ._graph import components

#: Most differing bits of a link.
BITS = 3
#: Buckets of more fingerprints are split by a byte more, then dealt over several tasks, in pairs of blocks of BLOCK fingerprints.
HOT, BLOCK = 4096, 2048
#: Bytes of a text whose shingles are hashed at a time.
PIECE = 1 << 20
_WHITE = re.compile(rb"\s")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of data, about PIECE bytes at a time."""
    at = 0
    while at < len(data):
        stop = _WHITE.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = stop.start() if stop else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of all shingles, repeats included; 0 without words. Shingles are hashed piece by piece, so a
    long text needs little more memory than itself."""
    hashed = xxhash.xxh64_intdigest
    ones, total, words = np.zeros(64, dtype=np.int64), 0, []

    def count(grams: Iterator[bytes]) -> int:
        h = np.fromiter((hashed(g, seed) for g in grams), dtype="<u8")
        for at in range(0, len(h), 65536):
            part = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[:] += part.sum(axis=0, dtype=np.int64)
        return len(h)

    for piece in _pieces(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else ():
        words += piece
        total += count(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
        words = words[max(0, len(words) - width + 1) :]
    if not total and words:  # fewer words than a shingle has
        total = count(iter([b" ".join(words)]))
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fingerprint as a signed bigint, the columns in keep) for every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), *(docs.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep).mapInArrow(run, schema)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def chain_keys(reps: DataFrame) -> DataFrame:
    """reps(rep, fp) -> (key, even, rep, fp): the keys of all chains of length 2. Bits 0 to 15 of a key hold the next
    segment, 16 to 31 the first, 32 and 33 the start; bit 34 is set if the next segments differ by one bit."""
    one_bit = F.lit(1 << 34).cast("bigint")

    def of_start(i: int) -> Column:
        after = _segment(i + 1)
        even = F.bit_count(after) % 2 == 0
        head = F.lit(i << 32).cast("bigint") + F.shiftleft(_segment(i), 16)
        flips = F.array(*[after.bitwiseXOR(F.lit(1 << b).cast("bigint")) for b in range(16)])
        near = F.transform(F.when(even, F.array(after)).otherwise(flips), lambda x: head + one_bit + x)
        return F.transform(F.concat(F.array(head + after), near), lambda k: F.struct(k.alias("key"), even.alias("even")))

    keys = [of_start(i) for i in range(4)]
    rows = reps.select(F.explode(F.concat(*keys)).alias("k"), "rep", "fp")
    return rows.select("k.key", "k.even", "rep", "fp")


def _linked(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which differences x (uint64) pass the chain of three segments from their starts (0 to 3), and the full check. The
    chains of one and two segments hold by the key."""
    turn = (np.asarray(start) * 16 + 48).astype(np.uint64) & np.uint64(63)  # where the chain's last but one segment ends
    hole = (np.uint64(0xFFFF) << turn).astype(np.uint64)
    return (np.bitwise_count(x & ~hole) <= 3 * BITS // 4) & (np.bitwise_count(x) <= BITS)


def _forest(sides: list[np.ndarray], fp: np.ndarray, rep: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected in one bucket. sides: the members, or the two kinds whose links count. Each
    member is searched from once at most."""
    left, out = list(sides), []
    while len(left[0]) and len(left[-1]):
        root, left[0] = left[0][:1], left[0][1:]
        frontier, side = [root, *(root[:0] for _ in left[1:])], 0
        while any(map(len, frontier)):
            other = len(left) - 1 - side
            now, frontier[side] = frontier[side], frontier[side][:0]
            hit = np.zeros(len(left[other]), dtype=bool)
            for at in range(0, len(now), 64):
                hit |= _linked(fp[now[at : at + 64], None] ^ fp[None, left[other]], start).any(axis=0)
            found, left[other] = left[other][hit], left[other][~hit]
            if len(found):
                out.append((np.full(len(found), rep[root[0]]), rep[found]))
                frontier[other] = np.concatenate((frontier[other], found))
            side = other
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, even, rep, fp) sorted by key and tile -> links (a, b)."""
    tail = None
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if tail is not None:
            now = [np.concatenate(x) for x in zip(tail, now, strict=True)]
        change = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        last = int(change[-1]) if len(change) else 0
        tail = [x[last:] for x in now]
        if last:
            yield from _links_of([x[:last] for x in now], change[:-1])
    if tail is not None and len(tail[0]) > 1:
        yield from _links_of(tail, np.array([], dtype=np.int64))


def _links_of(cols: list[np.ndarray], change: np.ndarray) -> Iterator[pa.RecordBatch]:
    key, _, even, rep, fp = cols
    fp = fp.view(np.uint64)
    bounds = np.concatenate(([0], change, [len(key)]))
    length = np.diff(bounds)
    run = np.repeat(np.arange(len(length)), length)
    small = length <= 32
    a, b = [], []
    rows = np.flatnonzero(small[run] & (length[run] > 1))
    for d in range(1, int(length[small].max(initial=1))):
        rows = rows[rows + d < len(key)]
        rows = rows[run[rows] == run[rows + d]]
        meet = (key[rows] >> 34 & 1 == 0) | (even[rows] != even[rows + d])
        i = rows[meet]
        hit = i[_linked(fp[i] ^ fp[i + d], key[i] >> 32 & 3)]
        a.append(rep[hit])
        b.append(rep[hit + d])
    for r in np.flatnonzero(~small):
        members = np.arange(bounds[r], bounds[r + 1])
        sides = [members] if key[members[0]] >> 34 & 1 == 0 else [members[even[members]], members[~even[members]]]
        for x, y in _forest(sides, fp, rep, int(key[members[0]] >> 32 & 3)):
            a.append(x)
            b.append(y)
    a, b = (np.concatenate(x) if x else np.array([], dtype=np.int64) for x in (a, b))
    if len(a):
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _longer_chains(rows: DataFrame) -> DataFrame:
    """Each row under four keys: with the number (bits 35 and 36) and value (bits 37 to 44) of a byte of the two segments that the
    chain of length 2 leaves out."""
    turn = "16 * cast((shiftright(key, 32) + 2) % 4 as int)"
    rest = F.expr(f"shiftrightunsigned(fp, {turn}) | shiftleft(fp, 64 - {turn})")
    keys = [F.col("key") + F.lit(p << 35).cast("bigint") + F.shiftleft(F.shiftright("rest", 8 * p).bitwiseAND(F.lit(255).cast("bigint")), 37) for p in range(4)]
    return rows.withColumn("rest", rest).select(F.explode(F.array(*keys)).alias("key"), "even", "rep", "fp")


def _tiles(hot: DataFrame) -> DataFrame:
    """Rows of hot buckets (with n, their size) under each pair of blocks that they take part in."""
    hot = hot.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("bigint"))
    hot = hot.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    hot = hot.select("key", "even", "rep", "fp", "blocks", "own", other.alias("other"))
    hot = hot.select("key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("tile"), "even", "rep", "fp")
    return hot.repartition("key", "tile").sortWithinPartitions("key", "tile")


def _within_buckets(cool: DataFrame) -> DataFrame:
    """Rows of buckets of at most HOT, sorted by key, without those that can have no link."""
    same = Window.partitionBy("key")
    counted = cool.withColumn("n", F.count("*").over(same)).withColumn("n_even", F.count_if("even").over(same))
    equal = F.shiftright("key", 34) % 2 == 0
    counted = counted.where((F.col("n") > 1) & (equal | ((F.col("n_even") > 0) & (F.col("n_even") < F.col("n")))))
    return counted.select("key", F.lit(0).cast("bigint").alias("tile"), "even", "rep", "fp").sortWithinPartitions("key")


def links(reps: DataFrame) -> DataFrame:
    """reps(rep, fp), fp distinct -> links (a, b) between reps that connect all fingerprints within BITS of each other.

    Buckets are counted by an aggregation, so no task gathers one before it is known to be small."""
    rows, parts = chain_keys(reps), []
    for level in range(2):
        hot = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot")
        parts.append(_within_buckets(join_heavy(rows, hot, ["key"], "n", how="left_anti")))
        if not hot.take(1):
            break
        more = join_heavy(rows, hot.withColumn("rows", F.col("n")), ["key"], "rows")
        if level == 0:
            rows = stored(_longer_chains(more), "longer_chains")
        else:
            parts.append(_tiles(more))
    found = [p.mapInArrow(_bucket_links, "a bigint, b bigint") for p in parts]
    return reduce(DataFrame.union, found).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose fingerprints are linked, over any number of links.

    Returns a row for each row of docs: <id_col>, fp (signed), fingerprint (16 hex digits), component_id (the smallest id
    reachable, itself included). <id_col> must be a bigint. Texts that are null, empty or white space have fingerprint 0
    and are linked like any other. The nodes are fingerprints, so copies cost no pairs, rows without an id link others like
    any row (a class that has no id at all has a null component_id), and several texts of one id each have the class of
    their own. Other columns are not read; an empty table gives an empty result.
    """
    if docs.schema[id_col].dataType != T.LongType():
        raise TypeError(f"{id_col} must be a bigint")
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "reps")
    found = components(links(reps.select(F.col("fp").alias("rep"), "fp")))
    classes = stored(reps.join(found, reps["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("class"), "least", "n"), "classes")
    ids = classes.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    labels = join_heavy(classes.drop("least"), ids, ["class"], "members").select("fp", "component_id", "n")
    out = join_heavy(rows, stored(labels, "labels"), ["fp"], "n")
    return out.select(F.col("id").alias(id_col), "fp", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(<id_col>, the columns in keep) of one row of each class of near duplicates: the first by id, null last, then by keep.

    The nodes are fingerprints, not ids: rows that share an id, or have none, are linked by their own texts alone.
    """
    rows = stored(fingerprints(docs, id_col, text_col, keep), "fingerprints")
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", *keep)
    reps = stored(rows.groupBy("fp").agg(F.min(row).alias("first")), "reps")
    found = components(links(reps.select(F.col("fp").alias("rep"), "fp")))
    first = reps.join(found, reps["fp"] == found["node"], "left").groupBy(F.coalesce("component", "fp").alias("class")).agg(F.min("first").alias("first"))
    return first.select(F.col("first.id").alias(id_col), *(F.col(f"first.{c}").alias(c) for c in keep))
