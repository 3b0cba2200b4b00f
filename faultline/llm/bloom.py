"""A bit table that tells most rows without a partner apart before they are moved.

It never turns a wanted row away; what it lets through is decided by the join behind it. Sixteen bits per id up to a fixed
size; with more ids it only lets more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm import text as tx

MOST_BITS = 1 << 27


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (tx.seeded(21, ids.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def bit_table(ids: DataFrame, column: str, rows: int) -> np.ndarray:
    """Packed bits of all values of a long column; ``rows`` is about how many there are."""
    bits = min(MOST_BITS, 1 << max(10, int(16 * max(1, rows) - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(), bits))
            word, first = np.unique(at >> 6, return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    found = ids.select(column).mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return table


def may_hold(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids, len(table) << 6)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
