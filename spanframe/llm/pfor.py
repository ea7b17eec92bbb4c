"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block holds up to BLOCK values: minimum (u32), number of values (u16), bits a value (u8), a zero byte, number of
exceptions (u16), a zero u16, the packed differences from the minimum (bits from the lowest on), the exceptions'
positions (u16 each) and their differences (u32 each). The width is what the percentile of the differences needs; wider
differences are exceptions and stand as 0 among the packed ones. All little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 4096
#: A narrower bit pays while exceptions (48 bits each) are fewer than one in 48.
PERCENTILE = 98.0
_HEAD = struct.Struct("<IHBxHxx")


def _pack(values: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _unpack(data: memoryview, n: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, dtype=np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.zeros((n, 32), dtype=np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """1 to BLOCK values."""
    low = int(values.min())
    diff = values.astype(np.int64) - low
    at = min(len(diff) - 1, int(np.ceil(len(diff) * percentile / 100)) - 1)
    width = int(np.partition(diff, at)[at]).bit_length()
    outlier = np.flatnonzero(diff >> width)
    packed = diff
    if len(outlier):
        packed = diff.copy()
        packed[outlier] = 0
    return b"".join((_HEAD.pack(low, len(diff), width, len(outlier)), _pack(packed, width), outlier.astype("<u2").tobytes(), diff[outlier].astype("<u4").tobytes()))


def decode_block(data: bytes | memoryview, at: int = 0) -> np.ndarray:
    view = memoryview(data)
    low, n, width, exceptions = _HEAD.unpack_from(view, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    out = _unpack(view[at : at + size], n, width)
    at += size
    if exceptions:
        where = np.frombuffer(view, dtype="<u2", count=exceptions, offset=at)
        out[where] = np.frombuffer(view, dtype="<u4", count=exceptions, offset=at + 2 * exceptions)
    return out + np.uint32(low)


def encode(values: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, list[int]]:
    """The blocks of values, and the byte at which each starts."""
    blocks = [encode_block(values[i : i + BLOCK], percentile) for i in range(0, len(values), BLOCK)]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:-1] if blocks else []
    return b"".join(blocks), [int(x) for x in starts]


def decode(data: bytes, starts: list[int], first: int = 0, count: int | None = None) -> np.ndarray:
    """Values first to first + count; only the blocks that hold them are read."""
    last = len(starts) - 1 if count is None else (first + count - 1) // BLOCK
    parts = [decode_block(data, starts[i]) for i in range(first // BLOCK, min(last, len(starts) - 1) + 1)]
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
    at = first - first // BLOCK * BLOCK
    return out[at:] if count is None else out[at : at + count]
