"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. A copy of an item with score S (match 1, mismatch and gap -1 or dearer) has at least S - 1 pairs of neighbouring words in
   common with it, as every edit parts one pair of matches at most. So of the item's word pairs, all but the S - 1
   that are in most documents are seeds, S being the least score that counts: whatever the edits, one of the rarer pairs is
   left. Nothing is lost by leaving out the common ones.
2. Documents look their word pairs up among the seeds. Each hit proposes the stretch of the document where the item would
   lie, with room for as many insertions as the score allows; overlapping stretches of one item are merged.
3. A stretch is passed over if it has fewer of the item's words, or of its word pairs, than the limit takes. The others are
   aligned with the item by Smith-Waterman. The score divided by the item's words is the similarity.

The test set is a table of its own and not part of the corpus. Up to ``most_words`` words of it are given to every task;
a larger one is worked through in slices of that size, one after the other, each by the same plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm import text as tx
from faultline.llm.storage import stored
from faultline.llm.sums import total_of

_OUT = "row_key long, item_id long, score double, first_word long, last_word long"


class Items:
    """Words and n-grams of a slice of the test set."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int, limit: float, costs: tuple[int, int, int]):
        t = tx.tokens(pa.array(texts, pa.string()))
        self.ids, self.limit, self.costs = np.array(ids, np.int64), limit, costs
        at = np.searchsorted(t.row, np.arange(len(texts) + 1))
        self.words = [t.hash[at[i] : at[i + 1]] for i in range(len(texts))]
        self.length = np.array([len(w) for w in self.words], np.int64)
        grams, own, pos = [], [], []
        for i, w in enumerate(self.words):
            size = min(n, len(w))  # an item of one word is looked up by it, see `sizes`
            if size:
                h, first = tx.ngram_hashes(np.zeros(len(w), np.int64), w, size)
                grams.append(h)
                own.append(np.full(len(h), i))
                pos.append(first)
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.own = np.concatenate(own) if own else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos) if pos else np.zeros(0, np.int64)
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        # word pairs that a copy has in common with the item at least
        self.shared = np.array([max(1, math.ceil(limit * k - 1e-9) - 1) for k in self.length.tolist()], np.int64)
        self.distinct = np.unique(self.gram)

    def keep_rare(self, documents: np.ndarray) -> None:
        """Seeds are the n-grams in fewest documents; as many common ones go as cannot be all that a copy has."""
        count = documents[np.searchsorted(self.distinct, self.gram)]
        order = np.lexsort((self.pos, count, self.own))
        first = np.searchsorted(self.own[order], np.arange(len(self.words)))
        nth = np.arange(len(order)) - first[self.own[order]]
        total = np.bincount(self.own, minlength=len(self.words))
        kept = order[nth <= (total - self.shared)[self.own[order]]]
        kept = kept[np.argsort(self.gram[kept], kind="stable")]
        self.gram, self.own, self.pos = self.gram[kept], self.own[kept], self.pos[kept]

    def flag(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << 20) - 1)).astype(np.int64)

    def index(self) -> None:
        self.flags = np.zeros(1 << 20, bool)  # most n-grams of a corpus are dismissed by one look here
        self.flags[self.flag(self.gram)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes: (index into h, index into gram) of all equal ones."""
        maybe = np.flatnonzero(self.flags[self.flag(h)])
        a, b = np.searchsorted(self.gram, h[maybe]), np.searchsorted(self.gram, h[maybe], "right")
        many = b - a
        maybe, a, many = maybe[many > 0], a[many > 0], many[many > 0]
        first = np.cumsum(many) - many
        return np.repeat(maybe, many), np.arange(int(many.sum())) - np.repeat(first, many) + np.repeat(a, many)

    def found_in(self, part: pa.RecordBatch, column: str) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(row of the batch, item) -> score, first and last word of its best stretch."""
        t = tx.tokens(part.column(column))
        ends = np.searchsorted(t.row, np.arange(part.num_rows + 1))
        found = [(np.zeros(0, np.int64),) * 3]
        for size in self.sizes:
            h, at = tx.ngram_hashes(t.row, t.hash, size)
            i, j = self.hits(h)
            found.append((at[i], self.own[j], self.pos[j]))
        word, own, pos = (np.concatenate(c) for c in zip(*found))
        slack = ((1 - self.limit) * self.length[own]).astype(np.int64) + 1
        a = np.maximum(word - pos - slack, ends[t.row[word]])
        b = np.minimum(word - pos + self.length[own] + slack, ends[t.row[word] + 1])
        order = np.lexsort((a, own, t.row[word]))
        row, own, a, b = (x[order].tolist() for x in (t.row[word], own, a, b))
        out: dict[tuple[int, int], tuple[float, int, int]] = {}
        k = 0
        while k < len(row):
            r, item, low, high = row[k], own[k], a[k], b[k]
            k += 1
            while k < len(row) and row[k] == r and own[k] == item and a[k] <= high:
                high = max(high, b[k])
                k += 1
            x, y = self.words[item], t.hash[low:high]
            least = self.limit * len(x)
            if high - low < least or most_matches(x, y) < least:
                continue
            if len(x) > 1 and most_matches(_pairs(x), _pairs(y)) < self.shared[item]:
                continue
            best, first, last = smith_waterman(x, y, *self.costs)
            score = best / (self.costs[0] * len(x))
            if score >= self.limit and score > out.get((r, item), (0.0,))[0]:
                base = low - int(ends[r])
                out[r, item] = (score, base + first, base + last)
        return out


def _pairs(words: np.ndarray) -> np.ndarray:
    return tx.ngram_hashes(np.zeros(len(words), np.int64), words, 2)[0]


def smith_waterman(x: np.ndarray, y: np.ndarray, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Best local alignment score of two word sequences, and where in ``y`` it begins and ends (half open).

    Row by row over ``x``; gaps along ``y`` within a row by a running maximum, so each row is a few numpy operations."""
    m = len(y)
    ramp = np.arange(m + 1) * -gap
    score, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, span = 0, (0, 0)
    for w in x:
        diagonal = score[:-1] + np.where(y == w, match, mismatch)
        above = score[1:] + gap
        now, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
        use = np.maximum(diagonal, above)
        open_ = use > 0
        now[1:][open_] = use[open_]
        start[1:][open_] = np.where(diagonal >= above, begin[:-1], begin[1:])[open_]
        lifted = now + ramp
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(m + 1), 0))
        score, begin = peak - ramp, start[source]
        k = int(np.argmax(score))
        if score[k] > best:
            best, span = int(score[k]), (int(begin[k]), k)
    return best, *span


def most_matches(x: np.ndarray, y: np.ndarray) -> int:
    """At least as many as the words that any alignment of ``x`` and ``y`` matches."""
    return int(min(np.isin(x, y).sum(), np.isin(y, x).sum()))


def _documents(items: Items):
    """How many documents hold each distinct n-gram of the items, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.distinct), np.int64)
        flags = np.zeros(1 << 20, bool)
        flags[items.flag(items.distinct)] = True
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                t = tx.tokens(part.column("text"))
                for size in items.sizes:
                    h, at = tx.ngram_hashes(t.row, t.hash, size)
                    maybe = np.flatnonzero(flags[items.flag(h)])
                    place = np.minimum(np.searchsorted(items.distinct, h[maybe]), len(total) - 1)
                    hit = items.distinct[place] == h[maybe]
                    pairs = np.unique(t.row[at[maybe[hit]]].astype(np.int64) << 32 | place[hit])
                    total += np.bincount(pairs & 0xFFFFFFFF, minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _found(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items.index()
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                out = items.found_in(part, "text")
                keys = part.column("row_key")
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array([r for r, _ in out], pa.int64())), pa.array([int(items.ids[i]) for _, i in out], pa.int64()),
                     pa.array([v[0] for v in out.values()], pa.float64()), pa.array([v[1] for v in out.values()], pa.int64()),
                     pa.array([v[2] for v in out.values()], pa.int64())],
                    ["row_key", "item_id", "score", "first_word", "last_word"],
                )

    return run


def _clean(items: Items, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items.index()
        for batch in batches:
            for part in tx.chunks(batch, column):
                clean = np.ones(part.num_rows, bool)
                clean[[r for r, _ in items.found_in(part, column)]] = False
                yield part.filter(pa.array(clean))

    return run


def _slices(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, n: int, limit: float, costs: tuple,
            most_words: int) -> Iterator[Items]:
    """The test set in slices with their seeds chosen, one at a time."""
    if costs[0] > min(-costs[1], -costs[2]):
        raise ValueError("a match must not outweigh a mismatch or a gap")
    listed = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("x")).filter(
        "i is not null and x is not null"
    )
    sized = listed.withColumn("words", F.coalesce(F.regexp_count("x", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))
    total = sized.agg(F.sum("words")).first()[0] or 0
    slices = max(1, -(-int(total) // most_words))
    base = docs.select(F.col(text_col).cast("string").alias("text"))
    for k in range(slices):
        own = sized.filter(F.pmod(F.xxhash64("i"), F.lit(slices)) == k).orderBy("i", "x").collect()
        part = Items([r["i"] for r in own], [r["x"] for r in own], n, limit, costs)
        if not len(part.gram):
            continue
        part.keep_rare(total_of(base.mapInArrow(_documents(part), "sums binary"), len(part.distinct), added=True))
        yield part


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = 2, limit: float = 0.4, costs: tuple[int, int, int] = (1, -1, -1),
    most_words: int = 1_000_000,
) -> DataFrame:
    """Documents that hold a test item, copied or edited: ``id_col``, ``item_id``, ``score``, ``first_word``,
    ``last_word`` (the stretch of the document's words, half open), best stretch per row and item.

    ``score`` is the Smith-Waterman score over the item's words, 1 for a full copy; all pairs from ``limit`` on are given
    (with ``n`` above 2 those whose edits leave a rare run of ``n`` words).

    Defined cases: null or empty texts and items hold nothing. Items of one or two words are sought whole. Rows that
    repeat give a row each. Rows with a null id are judged too (null id in the result). Items with a null id are left
    out. Empty tables give an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("row_key"), F.col(text_col).cast("string").alias("text"))
    out = base.sparkSession.createDataFrame([], _OUT)
    for part in _slices(docs, items, text_col, item_id, item_text, n, limit, costs, most_words):
        out = out.unionByName(stored(base.mapInArrow(_found(part), _OUT), "leaks"))
    return out.withColumnRenamed("row_key", id_col)


def without_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 2,
    limit: float = 0.4, costs: tuple[int, int, int] = (1, -1, -1), most_words: int = 1_000_000,
) -> DataFrame:
    """``docs`` without the rows that hold a test item. Each row is judged by itself and travels with its text, so rows that
    share an id, or have none, are kept or dropped one by one. Other cases as in `leaks`; ``text_col`` is a string."""
    out = docs
    for part in _slices(docs, items, text_col, item_id, item_text, n, limit, costs, most_words):
        out = out.mapInArrow(_clean(part, text_col), docs.schema)
    return out
