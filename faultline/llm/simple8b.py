"""Simple-8b: whole numbers in 64-bit words, a selector of 4 bits and up to 60 numbers of one width.

Numbers are coded in blocks. A block's words stand together, then the numbers too wide for any selector (60 bits) as they
are; the block table has the place and count of both, so that any block, or all at once, decode without a look at others.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Numbers in a word and bits of each, by selector; selector 15 is a word that stands for one wide number.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
BLOCK = 1024
_SLICE = 256 * BLOCK


class Coded(NamedTuple):
    """Words of all blocks, and per block the first word and the number of wide ones at its end."""

    words: np.ndarray
    first: np.ndarray
    wide: np.ndarray


def _bits(values: np.ndarray) -> np.ndarray:
    top = values >> np.uint64(32)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(top > 0, 32 + np.frexp(top.astype(np.float64))[1], low).astype(np.uint8)


def _selectors(values: np.ndarray, blocks: int) -> np.ndarray:
    """For each place the selector that packs most numbers from there; behind a block's end all numbers fit."""
    bits = np.zeros((blocks, BLOCK + COUNTS[0]), np.uint8)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[: len(values)] = _bits(values)
    bits[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    best = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    widest, had = bits, 1
    for s in range(len(COUNTS) - 1, -1, -1):  # fewer and wider first; more numbers take over where they fit
        if step := int(COUNTS[s]) - had:  # at most as many more as there were
            wider = widest.copy()
            np.maximum(widest[:, :-step], widest[:, step:], out=wider[:, :-step])
            widest, had = wider, int(COUNTS[s])
        np.copyto(best, s, where=widest[:, :BLOCK] <= WIDTHS[s])
    return best.ravel()


def _encode(values: np.ndarray) -> Coded:
    blocks = -(-len(values) // BLOCK)
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, len(values))
    selector = _selectors(values, blocks)
    counts = np.ones(16, np.int64)
    counts[: len(COUNTS)] = COUNTS
    place, live, starts, owner = np.arange(blocks) * BLOCK, np.arange(blocks), [], []
    while len(live):  # one word of every unfinished block at a time
        starts.append(place)
        owner.append(live)
        place = place + counts[selector[place]]
        more = place < ends[live]
        place, live = place[more], live[more]
    start, block = np.concatenate(starts), np.concatenate(owner)
    start.sort()  # blocks follow one another, so places in order are words in order
    kind = selector[start]
    many = np.minimum(counts[kind], ends[start // BLOCK] - start)
    escape = np.flatnonzero(kind == ESCAPE)
    n_words = np.bincount(block, minlength=blocks)
    wide = np.bincount(start[escape] // BLOCK, minlength=blocks)
    first = np.append(0, np.cumsum(n_words + wide))
    at = np.arange(len(start)) + np.repeat(first[:-1] - np.append(0, np.cumsum(n_words))[:-1], n_words)
    words = np.zeros(first[-1], np.uint64)
    words[at] = kind.astype(np.uint64) << np.uint64(60)
    for s, (c, w) in enumerate(zip(COUNTS, WIDTHS)):
        own = np.flatnonzero(kind == s)
        for i in range(c):
            own = own[many[own] > i]
            words[at[own]] |= values[start[own] + i] << np.uint64(i * w)
    if len(escape):
        in_block = start[escape] // BLOCK
        nth = np.arange(len(escape)) - np.append(0, np.cumsum(wide))[in_block]
        words[first[in_block] + n_words[in_block] + nth] = values[start[escape]]
    return Coded(words, first[:-1], wide)


def encode(values: np.ndarray) -> Coded:
    """Unsigned 64-bit numbers of any size, coded a few hundred blocks at a time."""
    values = np.ascontiguousarray(values, np.uint64)
    parts, base = [], 0
    for i in range(0, len(values), _SLICE):
        c = _encode(values[i : i + _SLICE])
        parts.append(Coded(c.words, c.first + base, c.wide))
        base += len(c.words)
    if not parts:
        return Coded(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Coded(*(np.concatenate(x) for x in zip(*parts)))


def decode(coded: Coded, n: int) -> np.ndarray:
    """The ``n`` numbers again; every step takes all words of one selector at once."""
    words, first, wide = coded
    blocks = len(first)
    if not blocks:
        return np.zeros(0, np.uint64)
    stop = np.append(first[1:], len(words))
    is_word = np.ones(len(words), bool)
    raw = np.repeat(stop - wide, wide) + np.arange(int(wide.sum())) - np.repeat(np.append(0, np.cumsum(wide))[:-1], wide)
    is_word[raw] = False
    block = np.repeat(np.arange(blocks), stop - first)[is_word]
    packed, rest = words[is_word], words[raw]
    kind = (packed >> np.uint64(60)).astype(np.int64)
    many = np.append(COUNTS, [0, 1])[kind]
    before = np.append(0, np.cumsum(many))[:-1]
    head = np.append(True, block[1:] != block[:-1])
    start = before - np.repeat(before[head], np.diff(np.append(np.flatnonzero(head), len(block)))) + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s, (c, w) in enumerate(zip(COUNTS, WIDTHS)):
        own = np.flatnonzero(kind == s)
        mask = np.uint64((1 << int(w)) - 1)
        for i in range(c):
            own = own[start[own] + i < end[own]]
            out[start[own] + i] = packed[own] >> np.uint64(i * w) & mask
    out[start[kind == ESCAPE]] = rest
    return out
