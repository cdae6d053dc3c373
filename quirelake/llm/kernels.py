"""Vectorised text kernels over Arrow string batches.

All hashing works on prefix sums of ``table[byte] * base**i`` modulo 2**64: the hash of any span is one
subtraction and one multiplication, so words, k-grams and whole contexts are hashed without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Bytes of text handled at once; one longer document is still handled whole.
CHUNK_BYTES = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(salt: int, fold_ascii: bool = False) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    if fold_ascii:
        table[65:91] = table[97:123]
    return table


TABLES = (byte_table(1), byte_table(2))
FOLDED = byte_table(3, fold_ascii=True)

#: Separators: ASCII white space, and everything but letters, digits and bytes above 127.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i in 0..n, kept between calls up to a few chunks' length."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        base = BASES[which]
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 8 * CHUNK_BYTES:
            _POWERS[which] = have
    return have


class Spans:
    """Hashes of spans of a unit sequence (bytes through a table, or 64-bit word hashes)."""

    def __init__(self, units: np.ndarray, which: int = 0):
        n = len(units)
        power, self.inverse = powers(n, which)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(units * power[:n], out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every k consecutive units; length n - k + 1."""
        n = len(self.prefix) - 1
        return mix((self.prefix[k:] - self.prefix[: n + 1 - k]) * self.inverse[: n + 1 - k]) if n >= k else np.empty(0, np.uint64)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``limit`` bytes, or of one row; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each document's range in them (length documents + 1)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``starts``..``ends``, at most a chunk's bytes at once (or one longer word)."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right")))
        low = starts[at]
        out[at:end] = Spans(table[data[low : ends[end - 1]]]).hash(starts[at:end] - low, ends[at:end] - low)
        at = end
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (rightmost on ties) of every ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    bits = np.uint64(32)  # the same for every batch, so that equal spans choose alike; ties go by position
    mask = (np.uint64(1) << bits) - np.uint64(1)
    packed = (values >> bits << bits) | (mask - np.arange(n, dtype=np.uint64))
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[: n - width + 1], forward[width - 1 : n])
    return (mask - (least & mask)).astype(np.int64)


def winnow(grams: np.ndarray, ranges: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed positions: of every ``width`` consecutive k-grams of one document the smallest hash is kept.

    ``ranges`` bounds the documents' units.  Every span of ``width + k - 1`` units holds a kept k-gram, at an
    offset that depends on the span's content alone.  Returns positions and their documents.
    """
    n = int(ranges[-1])
    least = sliding_argmin(grams[: max(0, n - k + 1)], width)
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = np.zeros(len(least) + 1, np.int32)
    room = np.diff(ranges) >= width + k - 1
    np.add.at(whole, ranges[:-1][room], 1)
    np.add.at(whole, ranges[1:][room] - (width + k - 2), -1)
    chosen = np.unique(least[np.cumsum(whole[:-1]) > 0])
    return chosen, np.searchsorted(ranges, chosen, side="right") - 1
