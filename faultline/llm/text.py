"""Words, lines and their hashes for whole Arrow batches of texts, without a Python loop over words.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased and nothing else is. All functions
work on the UTF-8 bytes, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21  # text looked at in one numpy pass; a longer text is a chunk by itself

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Tokens(NamedTuple):
    """Words of a batch in order of text: row of the batch, and 64-bit hash of the lower-cased word."""

    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, x: np.ndarray) -> np.ndarray:
    """A family of hashes of 64-bit values."""
    return mixed(x ^ mixed(np.array([seed + 1], np.uint64) * _STEP))


def _byte_codes(seed: int) -> np.ndarray:
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(256 * seed + 1)) * _STEP)


_CODES = {0: _byte_codes(0), 1: _byte_codes(1)}
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(1 << max(8, int(n - 1).bit_length()), 0xD6E8FEB86659FD93, np.uint64)
        base[0] = 1
        _POWERS = np.cumprod(base, dtype=np.uint64)
    return _POWERS


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``most`` bytes of text each (a single longer text stands alone)."""
    offsets = _offsets(batch.column(column))[1]
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield batch.slice(first, last - first)
        first = last


def _offsets(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return texts, np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    return texts, raw.astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more entry for the end); null is empty."""
    texts, offsets = _offsets(texts)
    buffer = texts.buffers()[2] if len(texts) else None
    if buffer is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the lower-cased bytes of each span; spans are in order and do not overlap or touch zero length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    values = _CODES[seed][_LOWER[data[within + np.repeat(start, size)]]]
    values *= _powers(int(size.max()))[within]
    return mixed(np.add.reduceat(values, first) + size.astype(np.uint64) * _STEP)


def tokens(texts: pa.Array) -> Tokens:
    """All words of a chunk of texts."""
    data, offsets = text_bytes(texts)
    inside = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | begins[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | begins[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Tokens(row, span_hashes(data, start, end), start, end, data)


class Lines(NamedTuple):
    """Lines of a chunk split at line feeds, in order; every text has one at least. ``key`` says whether the stripped
    line has enough code points; ``hi`` and ``lo`` are its hashes (0 otherwise). ``start`` and ``end`` include the
    stripped ends but not the line feed."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    data: np.ndarray


def lines(texts: pa.Array, least: int) -> Lines:
    data, offsets = text_bytes(texts)
    feeds = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    start = np.concatenate([offsets[:-1], feeds + 1])
    row = np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty_like(start)
    if n:
        end[:-1] = start[1:] - 1
        final = np.append(row[1:] != row[:-1], True)
        end[final] = offsets[1:]
    solid = np.flatnonzero(~_SPACE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = b > a
    first, last = np.zeros_like(start), np.zeros_like(start)
    first[some], last[some] = solid[a[some]], solid[b[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    key = some & (points[last] - points[first] >= least)
    hi, lo = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    hi[key] = span_hashes(data, first[key], last[key], 0)
    lo[key] = span_hashes(data, first[key], last[key], 1)
    return Lines(row, start, end, key, hi, lo, data)


def ngram_hashes(row: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that stay inside a row, and the index of their first word."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(word) - n + 1, np.uint64)
    for i in range(n):
        total *= np.uint64(0x9FB21C651E98DF25)
        total += word[i : len(word) - n + 1 + i]
    at = np.flatnonzero(row[: len(word) - n + 1] == row[n - 1 :])
    return mixed(total[at]), at
