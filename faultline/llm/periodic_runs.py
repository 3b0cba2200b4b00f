"""Runs (maximal repetitions) of words in texts by enumerating maximal pairs over LCP-interval trees.

*Maximal pairs.* Two places i < j of a text whose words agree for exactly l places, and not one place to the left (their
left words differ). With q = j - i <= l that is a run: words i to j + l - 1 have period q, and neither neighbour extends it.
Nothing has to be extended afterwards. Several pairs give the same stretch with multiples of its period; the smallest
is kept.

*Tree.* Suffixes are sorted by prefix doubling; lengths of common prefixes (LCP) of neighbours follow from the ranks of
the doublings. Intervals of the order that share l words form a tree, which is walked bottom-up: an interval's list
holds its places in order, each with its class (the word to its left), and two intervals meet at the largest LCP
between them, the shorter list going into the longer. A pair that spans them differs behind l words. Of the pairs of
one place only that with its nearest neighbour in the list matters: a farther one at distance q' <= l agrees on l
words with the place, with the nearest (distance q) and with itself, so both q and q' - q are periods of those l words,
then so is their greatest common divisor, and the nearest place being nearest, q divides q': the same period repeated.

*What is left out beforehand.* A run of ``least`` words or more with q <= l has l >= least / 2. So only places whose
next ``least / 2`` words come again in their text are in the tree, and an interval is entered only where some two
neighbouring places are no farther apart than its longest LCP. Both only skip intervals that hold no run.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm import text as tx

LEAST = 12
Rewrite = Callable[[int | None, int], np.ndarray | None]
_SCHEMA = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _suffixes(words: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, and the ranks after each doubling: ranks[t] is equal where 2**t words are. ``words`` ends
    every text with a number that comes nowhere else."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.append(True, words[order[1:]] != words[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, k = [rank.astype(np.int32)], 1
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, n))
    at = np.flatnonzero(np.repeat(size > 1, size))  # places of the order that are not decided yet
    while len(at):
        own = order[at]
        key = rank[own] << 32 | rank[own + k]
        sort = np.argsort(key, kind="stable")
        own, key = own[sort], key[sort]
        order[at] = own
        first = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[own] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        ranks.append(rank.astype(np.int32))
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(at)))
        at = at[np.repeat(size > 1, size)]
        k *= 2
    return order, ranks


def _common(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the suffixes at i and j (different places) have in common."""
    out = np.zeros(len(i), np.int64)
    for t in range(len(ranks) - 1, -1, -1):
        same = ranks[t][i + out] == ranks[t][j + out]
        out[same] += 1 << t
    return out


def _entered(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each place's interval, or -1 where the interval holds no run, and the LCP with the place before inside
    it (0 at its start). Starts from intervals at the least LCP and cuts them where the LCP is below the smallest distance of
    two places, until that changes nothing."""
    joined = lcp > 0  # with the place before
    while True:
        interval = np.cumsum(~joined) - 1
        n = int(interval[-1]) + 1 if len(interval) else 0
        by_place = np.lexsort((order, interval))
        gap = np.diff(order[by_place])
        gap[np.diff(interval[by_place]) > 0] = np.iinfo(np.int64).max
        smallest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(smallest, interval[by_place][1:], gap)
        cut = joined & (lcp < smallest[interval])
        if not cut.any():
            break
        joined &= ~cut
    size = np.bincount(interval, minlength=n)
    return np.where(size[interval] > 1, interval, -1), np.where(joined, lcp, 0)


def _meet(places: list[int], lcps: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """Maximal pairs (i, j, l) with j - i <= l and j - i + l >= ``least`` of one interval: ``places`` in order of their
    suffixes, ``lcps`` with the one before, ``left`` the class of each."""
    n = len(places)
    owner = list(range(n))

    def find(x: int) -> int:
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    lists = [[(p, c)] for p, c in zip(places, left)]
    found = []
    for r in sorted(range(1, n), key=lambda r: -lcps[r]):
        l, x, y = lcps[r], find(r - 1), find(r)
        if len(lists[x]) < len(lists[y]):
            x, y = y, x
        long, short = lists[x], lists[y]
        for entry in short:
            p, c = entry
            at = bisect_left(long, entry)
            if at:
                o, other = long[at - 1]
                if other != c and p - o <= l and p - o + l >= least:
                    found.append((o, p, l))
            if at < len(long):
                o, other = long[at]
                if other != c and o - p <= l and o - p + l >= least:
                    found.append((p, o, l))
        if len(short) * 8 > len(long):
            lists[x] = sorted(long + short)
        else:
            for entry in short:
                long.insert(bisect_left(long, entry), entry)
        lists[y] = []
        owner[y] = x
    return found


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """All runs of the texts of a chunk: text, start (word of the text), length, smallest period, in this order. ``words``
    are 64-bit names of the words of all texts, ``first`` where each text begins and the end of the last."""
    none = (np.zeros(0, np.int64),) * 4
    half = (least + 1) // 2
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    grams, at = tx.ngram_hashes(row, words, half)
    if not len(at):
        return none
    mark = tx.mixed(grams ^ tx.mixed(row[at].astype(np.uint64)))
    order = np.argsort(mark)
    again = np.zeros(len(mark), bool)
    same = mark[order[1:]] == mark[order[:-1]]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    wanted = np.zeros(len(counts), bool)
    wanted[row[at[again]]] = True
    if not wanted.any():
        return none
    # the texts that have such a place, each behind a number of its own
    keep = np.flatnonzero(wanted[row])
    texts = np.flatnonzero(wanted)
    sizes = counts[texts]
    _, names = np.unique(words[keep], return_inverse=True)
    begin = np.append(0, np.cumsum(sizes + 1))
    body = np.arange(len(keep)) + np.repeat(np.arange(len(texts)), sizes)
    whole = np.empty(len(keep) + len(texts), np.int64)
    whole[body] = names + len(texts)
    whole[begin[1:] - 1] = np.arange(len(texts))
    order, ranks = _suffixes(whole, least)
    near = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    lcp = np.zeros(len(order), np.int64)
    lcp[near] = _common(ranks, order[near - 1], order[near])
    del ranks
    lcp[lcp < half] = 0
    inside = lcp > 0
    inside[:-1] |= lcp[1:] > 0
    order, lcp = order[inside], lcp[inside]
    if not len(order):
        return none
    left = np.where(np.isin(order, begin[:-1]), -1 - order, whole[order - 1])  # a text's first place has a class of its own
    interval, lcp = _entered(order, lcp)
    kept = interval >= 0
    order, lcp, left, interval = order[kept], lcp[kept], left[kept], interval[kept]
    if not len(order):
        return none
    size = np.diff(np.append(np.flatnonzero(lcp == 0), len(order)))
    head = np.cumsum(size) - size
    pairs = []
    two = head[size == 2]
    i, j, l = np.minimum(order[two], order[two + 1]), np.maximum(order[two], order[two + 1]), lcp[two + 1]
    ok = (left[two] != left[two + 1]) & (j - i <= l) & (j - i + l >= least)
    pairs.append(np.stack([i[ok], j[ok], l[ok]], 1))
    for h, s in zip(head[size > 2].tolist(), size[size > 2].tolist()):
        got = _meet(order[h : h + s].tolist(), lcp[h : h + s].tolist(), left[h : h + s].tolist(), least)
        if got:
            pairs.append(np.array(got, np.int64))
    i, j, l = np.concatenate(pairs).T
    if not len(i):
        return none
    start, period, length = i, j - i, j - i + l
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))
    start, period, length = start[smallest], period[smallest], length[smallest]
    text = np.searchsorted(begin, start, "right") - 1
    start = start - begin[text]
    order = np.lexsort((period, start, text))
    return texts[text][order], start[order], length[order], period[order]


def _covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, stop, -1)
    return np.cumsum(delta[:-1]) > 0


def _runs_in(piece: pa.RecordBatch, least: int, rewrite: Rewrite | None) -> pa.RecordBatch:
    tokens = tx.tokens(piece.column("text"))
    rows = piece.num_rows
    first = np.searchsorted(tokens.row, np.arange(rows + 1))
    ids = piece.column("id").to_pylist()
    source = np.arange(len(tokens.row))
    changed = np.zeros(rows, bool)
    if rewrite:
        for r, i in enumerate(ids):
            own = rewrite(i, int(first[r + 1] - first[r]))
            if own is not None:
                source[first[r] : first[r + 1]] = first[r] + own
                changed[r] = True
    # names of words as they are: the hash of the lower-cased word, and whether A-Z are in it, decide
    words = _exact_names(tokens)[source]
    text, start, length, period = runs_of(words, first, least)
    gone = _covered(len(words), first[text] + start + period, first[text] + start + length)
    touched = changed.copy()
    touched[text] = True
    cells, cut = [], np.searchsorted(text, np.arange(rows + 1))
    for r, t in enumerate(piece.column("text").to_pylist()):
        own = (t or "").encode("utf-8", "surrogatepass").split()
        if touched[r]:
            a, b = first[r], first[r + 1]
            own = [own[i] for i in (source[a:b][~gone[a:b]] - a).tolist()]
        cells.append(b" ".join(own))
    runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [piece.column("id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs), pa.array(cells, pa.binary()).cast(pa.string())],
        ["id", "n_words", "runs", "collapsed"])


def _exact_names(tokens: tx.Tokens) -> np.ndarray:
    """64-bit names of words with upper and lower case apart."""
    upper = (tokens.data >= 65) & (tokens.data <= 90)
    place = np.append(0, np.cumsum(upper))
    some = np.flatnonzero(place[tokens.end] > place[tokens.start])
    names = tokens.hash.copy()
    if len(some):
        at = np.flatnonzero(upper)
        lo, hi = place[tokens.start[some]], place[tokens.end[some]]
        which = np.repeat(np.arange(len(some)), hi - lo)
        within = at[np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        codes = tx.mixed((within - tokens.start[some][which]).astype(np.uint64) + np.uint64(0x51ED270B7F2E8D31))
        names[some] = tx.mixed(names[some] + np.add.reduceat(codes, np.cumsum(hi - lo) - (hi - lo)))
    return names


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rewrite: Rewrite | None = None,
) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``runs`` (start word, length, smallest period, by start and period) and
    ``collapsed``: the words that no run covers behind its first period, joined by one space.

    A run is a stretch of at least ``least`` words and of twice its smallest period that neither neighbouring word
    extends; words are byte for byte equal. ``rewrite`` gets an id and a number of words and may return which word
    stands at each place instead of its own (None: as it is).

    Nothing is shuffled: every document is looked at where it is read. Null, empty and blank texts have no words, no runs and
    an empty ``collapsed``; null ids stay; repeated rows are documents of their own; an empty table gives none; other columns
    are ignored. A text of any length is taken whole: memory for one text is some 100 bytes a word if it repeats itself.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.chunks(batch, "text"):
                yield _runs_in(piece, least, rewrite)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_col)
