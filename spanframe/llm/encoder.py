"""Encoding with a public tokenizer file: the library's own model, with a bounded memo of words.

Texts of Latin letters (below U+0250) repeat most of their words, and the tokenizer files of the kind described by KNOWN
never join what white space separates. So such a text is lower-cased and split here as the file says, and the library's
model encodes each new word once. Everything else (other scripts, texts that hold a special token, files of another kind)
goes through the library's encode as a whole. Both ways give the same ids.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from array import array

import numpy as np

#: Most entries of each half of a memo. A full half becomes the older one, whose entries come back as they are met again, and the
#: older one goes: what is frequent stays, and words met once do not fill a worker's memory.
MEMO = 150_000
#: The normalizer, pre-tokenizer and model options of files that the memo serves.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
_LATIN = [chr(i) for i in range(0x250)]
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LETTERS, _NUMBERS = (re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == kind)) for kind in "LN")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{re.escape(_SPACE)}{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile("[^\x00-įı-ɏ]")


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")  # also holds for its lower case
        return True
    except UnicodeEncodeError:
        return not _OTHER.search(text) and not _OTHER.search(text.lower())


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level models: printable Latin-1 bytes stand for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        options = {k: v for k, v in said["model"].items() if k not in ("vocab", "merges")}
        plain = not any(x["normalized"] for x in said.get("added_tokens", [])) and not said.get("truncation") and not said.get("padding")
        self.known = plain and KNOWN == {"normalizer": said.get("normalizer"), "pre_tokenizer": said.get("pre_tokenizer"), "model": options}
        self.special = re.compile("|".join(re.escape(x["content"]) for x in said.get("added_tokens", [])) or "(?!)")
        self.code = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}

    def _model(self, word: str) -> bytes:
        spelt = word if word.isascii() and word.isprintable() and " " not in word else "".join(map(_LETTER.__getitem__, word.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _word(self, word: str) -> bytes:
        """ids of a word; those of a word between spaces are kept once, as a chunk."""
        if (found := self.chunks.get(word)) is None and (found := self.words.get(word)) is None:
            if (found := self.old_words.get(word)) is None and (found := self.old_chunks.get(word)) is None:
                found = self._model(word)
            if len(self.words) >= MEMO:
                self.words, self.old_words = {}, self.words
            if len(word) <= 64:
                self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        """ids of what stands between two spaces."""
        if (found := self.chunks.get(chunk)) is None and (found := self.old_chunks.get(chunk)) is None:
            if not chunk.isalpha():
                found = b"".join(map(self._word, _PIECES.findall(chunk)))
            elif (found := self.words.get(chunk)) is None and (found := self.old_words.get(chunk)) is None:
                found = self._model(chunk)
        if len(self.chunks) >= MEMO:
            self.chunks, self.old_chunks = {}, self.chunks
        if len(chunk) <= 64:
            self.chunks[chunk] = found
        return found

    def _bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or not _is_latin(text) or self.special.search(text):
            return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = text.lower().replace("\n", " ").split(" ")
        found = list(map(self.chunks.get, chunks))
        if None in found:
            for i in [i for i, x in enumerate(found) if x is None]:
                found[i] = self._chunk(chunks[i])
        return b"".join(found)

    def encode(self, text: str | None) -> np.ndarray:
        """ids of the whole text without special tokens; none for null."""
        return np.frombuffer(self._bytes(text), dtype=self.kind)

    def count(self, text: str | None) -> int:
        return len(self._bytes(text)) // self.kind.itemsize


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
