"""Piece encoding and decoding with merge-type (BPE) SentencePiece vocabularies, checked against the library.

A text is its normalized characters; the agenda holds each pair of adjacent symbols whose concatenation is a piece. The pair
of the best score is merged first, of equal scores the leftmost; a merge makes two new pairs with its neighbours, and pairs
whose symbols have changed meanwhile are dropped when their turn comes. What is left becomes ids: a symbol that is no piece
becomes its UTF-8 bytes, or the unknown id where the vocabulary has no bytes.

Where no piece holds a space after another character, and none holds a line feed inside, no merge crosses such a place: a
text then falls into chunks whose agendas are independent, and a bounded memo keeps the ids of short chunks. The new words of a
batch have their agendas as the rows of a matrix, and other chunks one by one as a heap. Every Arrow batch is then encoded by
the library too, and a difference is an error.
"""

from __future__ import annotations

import functools
import heapq
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most entries of the memo (a full one starts afresh), and the longest chunk that it keeps.
MEMO, MEMO_CHARS = 1_000_000, 48
#: Characters of text that are encoded, compared and handed on together (a longer text is alone).
TOGETHER = 1 << 20
#: Marks that often stand behind a word.
TAIL = ",.;:!?*#$%)]}'\""
#: Fixed values of the vocabulary format: the space's stand-in, the number of the merge type, piece types.
SPACE, MERGE_TYPE = "▁", 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol-buffer wire format; fixed-width values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Pieces:
    """A vocabulary file: merge type, identity normalizer, spaces as prefix stand-ins. Others raise ValueError."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer = dict(x for n, v in parts if n == 2 for x in _fields(v))
        normal = dict(x for n, v in parts if n == 3 for x in _fields(v))
        types = [dict(_fields(v)).get(3, NORMAL) for n, v in parts if n == 1]
        if trainer.get(3, 1) != MERGE_TYPE or trainer.get(24, 0):
            raise ValueError("the vocabulary is not of the merge type with spaces as prefixes")
        if normal.get(2) or normal.get(1, b"identity") != b"identity" or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("the vocabulary's normalizer is not the identity with spaces kept and escaped")
        if USER in types or UNUSED in types:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if normal.get(3, 1) else ""
        names = [self.library.id_to_piece(i) for i in range(len(types))]
        self.ids = {names[i]: i for i, t in enumerate(types) if t == NORMAL}
        self.cost = {names[i]: -self.library.get_score(i) for i, t in enumerate(types) if t == NORMAL}
        self.bytes = {int(names[i][3:5], 16): i for i, t in enumerate(types) if t == BYTE} if trainer.get(35, 0) else {}
        self.unknown, self.size = self.library.unk_id(), len(types)
        inside = re.compile(f"[^{SPACE}]{SPACE}|\n.|.\n", re.DOTALL)
        # without bytes, neighbouring unknown symbols are one id, across chunks too
        self.chunked = bool(self.bytes) and not any(map(inside.search, self.ids))
        self.four = {p: i.to_bytes(4, sys.byteorder) for p, i in self.ids.items()}
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.letters = {p for p in self.ids if len(p) == 1}
        self.table = self._pair_table()
        self.memo: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    _CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _merged(self, text: str) -> list[str]:
        """The symbols of a normalized text after all merges, the agenda as a heap."""
        cost, push, pop = self.cost.get, heapq.heappush, heapq.heappop
        symbol, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, right, size = pop(heap)
            a, b = symbol[left], symbol[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            symbol[left], symbol[right] = (a := a + b), ""
            behind, ahead = before[left], after[right]
            after[left] = ahead
            if ahead >= 0:
                before[ahead] = left
                if (c := cost(both := a + symbol[ahead])) is not None:
                    push(heap, (c, left, ahead, len(both)))
            if behind >= 0 and (c := cost(both := symbol[behind] + a)) is not None:
                push(heap, (c, behind, left, len(both)))
        return [s for s in symbol if s]

    def _agenda(self, text: str) -> bytes:
        """ids of a normalized text (32 bits each), by merging pairs in the order of their scores."""
        symbols = self._merged(text)
        try:
            return b"".join([self.four[s] for s in symbols])
        except KeyError:
            return b"".join(self._four(symbols))

    def _pair_table(self) -> tuple[np.ndarray, ...]:
        """All pairs of pieces that join to a piece, by number: (first * size + second, cost, the piece); and each character's
        piece by code point (-1: none)."""
        found = [(a * self.size + b, self.cost[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None]
        keys, costs, joined = (np.array(x, t) for x, t in zip(zip(*sorted(found), strict=True), (np.int64, float, np.int32), strict=True))
        letters = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                letters[ord(p)] = i
        return keys, costs, joined, letters

    def _look(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, piece) of each pair; the cost is infinite where they do not join."""
        keys, costs, joined, _ = self.table
        key = first.astype(np.int64) * self.size + second
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, costs[at], np.inf), joined[at]

    def _agendas(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of many words, all of whose characters are pieces, at once: a row of a matrix is a word's agenda, the costs
        of its adjacent pairs, and each round merges every row's first least pair. A merge shortens a row by one, so rows of a
        length stay together: the longest go first, and meet the words of the next length."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        names: list[str] = []
        symbol, cost, name = np.zeros((0, 0), np.int32), np.zeros((0, 0)), np.zeros(0, np.int64)
        for n in range(max(by_length, default=0), 0, -1):
            if mine := by_length.get(n):
                code = np.frombuffer("".join(mine).encode("utf-32-le"), "<u4").reshape(-1, n)
                fresh = self.table[3][code]
                first = self._look(fresh[:, :-1], fresh[:, 1:])[0]
                here = np.arange(len(names), len(names) + len(mine))
                names += mine
                symbol, cost, name = (np.concatenate((x, y)) if len(x) else y for x, y in ((symbol, fresh), (cost, first), (name, here)))
            if not len(symbol):
                continue
            rows = np.arange(len(symbol))
            at = cost.argmin(axis=1) if n > 1 else np.zeros(len(symbol), np.int64)
            open_ = np.isfinite(cost[rows, at]) if n > 1 else np.zeros(len(symbol), bool)
            done = symbol[~open_].tobytes()
            for i, w in enumerate(name[~open_].tolist()):
                yield names[w], done[4 * n * i : 4 * n * (i + 1)]
            symbol, cost, name, at = symbol[open_], cost[open_], name[open_], at[open_]
            if not len(symbol):
                symbol, cost = np.zeros((0, 0), np.int32), np.zeros((0, 0))
                continue
            rows = np.arange(len(symbol))
            symbol[rows, at] = self._look(symbol[rows, at], symbol[rows, at + 1])[1]
            places = np.arange(n)
            symbol = symbol[places[None, :] != at[:, None] + 1].reshape(len(at), n - 1)
            cost = cost[places[None, : n - 1] != at[:, None]].reshape(len(at), n - 2)
            for side in (at - 1, at):  # the pairs on both sides of what was merged
                r = np.flatnonzero((side >= 0) & (side < n - 2))
                cost[r, side[r]] = self._look(symbol[r, side[r]], symbol[r, side[r] + 1])[0]

    def learn(self, texts: list[str | None]) -> None:
        """Puts the words of the texts that are new into the memo, many at once. Long words and those with other characters than
        pieces are left to packed."""
        if not self.chunked:
            return
        words = set().union(*[t.replace("\n", " ").split(" ") for t in texts if t])
        new = words.difference(self.spaced)
        if len(self.spaced) + len(new) > MEMO:
            self.spaced.clear()
            new = words
        bare = {self._bare(w) for w in new}.difference(self.spaced)
        known = self.letters
        many = [SPACE + w for w in bare if w and len(w) < MEMO_CHARS and SPACE not in w and known.issuperset(w)]
        self.spaced.update((w[1:], ids) for w, ids in self._agendas(many))

    def _bare(self, word: str) -> str:
        """A word without the marks behind it, if no piece joins the two."""
        bare = word.rstrip(TAIL)
        return bare if bare and word[len(bare) - 1 : len(bare) + 1] not in self.joined else word

    def _four(self, symbols: list[str]) -> Iterator[bytes]:
        """As self.four, with symbols that are no piece."""
        unknown = self.unknown.to_bytes(4, sys.byteorder)
        last = None
        for s in symbols:
            if (known := self.four.get(s)) is not None:
                yield (last := known)
            elif self.bytes:
                yield from (self.bytes[b].to_bytes(4, sys.byteorder) for b in s.encode())
            elif last != unknown:
                yield (last := unknown)

    def _chunk(self, chunk: str) -> bytes:
        if (found := self.memo.get(chunk)) is None:
            found = self._agenda(chunk)
            if len(chunk) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[chunk] = found
        return found

    def _spaced(self, word: str) -> bytes:
        """ids of a word behind one space; what stands behind it, if no piece joins the two, is a chunk of its own."""
        bare = self._bare(word)
        if bare != word:
            if (found := self.spaced.get(bare)) is None:
                found = self._spaced(bare)
            found += self._chunk(word[len(bare) :])
        else:
            found = self._agenda(SPACE + word)
        if len(word) <= MEMO_CHARS:
            if len(self.spaced) >= MEMO:
                self.spaced.clear()
            self.spaced[word] = found
        return found

    def packed(self, text: str | None) -> bytes:
        """ids of the whole text, 32 bits each, none for null or empty."""
        if not text:
            return b""
        escaped = self.prefix + text.replace(" ", SPACE)
        if not self.chunked:
            return self._agenda(escaped)
        out: list[bytes] = []
        for i, line in enumerate(escaped.split("\n")):
            if i:
                out.append(self._chunk("\n"))
            first, *words = line.split(SPACE)
            if "" in words:  # a run of spaces is one chunk with what follows it
                out.extend(map(self._chunk, self._CHUNKS.findall(line)))
                continue
            if first:
                out.append(self._chunk(first))
            found = list(map(self.spaced.get, words))
            if None in found:
                for j in [j for j, x in enumerate(found) if x is None]:
                    found[j] = self._spaced(words[j])
            out.extend(found)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.packed(text)).cast("i").tolist()

    def checked(self, texts: list[str | None], sizes: list[int], ids: np.ndarray) -> list[list[int]]:
        """The library's ids; an error if they are not the given ones (one text's behind the other's)."""
        said = self.library.encode([t or "" for t in texts], num_threads=1)
        if sizes != list(map(len, said)) or ids.tolist() != list(chain.from_iterable(said)):
            raise ValueError("ids differ from the sentencepiece library's")
        return said

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each worker process."""
    return Pieces(path)


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of neighbours that hold TOGETHER characters at most, or one text."""
    first, held, size = 0, [], 0
    for i, x in enumerate(texts):
        text = x.as_py()
        if held and size + len(text or "") > TOGETHER:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield first, held


def encode_pieces(docs: DataFrame, model: str, *, decode: bool = False, check: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row, and with decode the text that the ids decode to (decoded).

    Whole texts, without begin or end ids; null and empty texts have no ids and decode to the empty text. Ids may be null
    or repeat: a row stands for itself. Other columns are not read. check: each Arrow batch is encoded by the library too,
    and a difference raises. Texts are taken in groups of TOGETHER characters; a longer text is a group of its own.
    """
    fields = [docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.StringType())] if decode else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pieces(model)
        for b in batches:
            for at, texts in _groups(b.column(1)):
                code.learn(texts)
                packed = [code.packed(t) for t in texts]
                sizes = [len(x) // 4 for x in packed]
                ids = np.frombuffer(b"".join(packed), dtype=np.int32)
                said = code.checked(texts, sizes, ids) if check else None
                starts = np.cumsum([0, *sizes], dtype=np.int32)
                columns = [b.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(starts), pa.array(ids))]
                if decode:
                    columns.append(pa.array(code.decode(said or [memoryview(x).cast("i").tolist() for x in packed]), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


def decode_pieces(rows: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded): the text of each row's ids, by the library's decode. Null ids: null. Null entries are left out, and
    numbers outside of the vocabulary count as the unknown id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pieces(model)
        for b in batches:
            out = []
            for x in b.column(1):
                ids = x.as_py()
                out.append(None if ids is None else code.decode([[i if 0 <= i < code.size else code.unknown for i in ids if i is not None]])[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "decoded"])

    return rows.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("decoded", T.StringType())]))
