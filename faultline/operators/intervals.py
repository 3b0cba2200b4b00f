"""Points in intervals by an equi-join on nested blocks.

A join on the file alone compares every line of a file with every function of it. Here an interval is cut into the few
whole blocks of 1, 8, 64, ... numbers that make it up, at most 14 of a size, and a point looks at the one block of each size
it lies in. The blocks of an interval do not overlap, so a point meets an interval once, and nothing else: no test is
left after the join, and a file with very many lines is spread over as many join keys as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

SIZES = 16  # up to blocks of 8^15 numbers
_SIZE, _BLOCK, _LONGEST = "_size", "_block", "_longest"


def _numbers(low: Column, high: Column) -> Column:
    """``low`` up to but without ``high``."""
    return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))


def _named(size: int) -> Callable[[Column], Column]:
    return lambda block: F.struct(F.lit(size).alias(_SIZE), block.alias(_BLOCK))


def whole_blocks(start: Column, end: Column) -> Column:
    """The blocks, as (size, block) structs, that make up the numbers from ``start`` to ``end``; null if one is null."""
    start, past = start.cast("long"), end.cast("long") + 1
    first = [F.shiftright(start + (8**size - 1), 3 * size) for size in range(SIZES)]
    stop = [F.shiftright(past, 3 * size) for size in range(SIZES)]
    parts = []
    for size in range(SIZES):
        if size + 1 < SIZES:
            low, high = first[size + 1], stop[size + 1]  # these are covered by larger blocks
            outside = F.concat(_numbers(first[size], low * 8), _numbers(high * 8, stop[size]))
            found = F.when(low < high, outside).otherwise(_numbers(first[size], stop[size]))
        else:
            found = _numbers(first[size], stop[size])
        parts.append(F.transform(found, _named(size)))
    return F.when(start < past, F.concat(*parts))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str) -> DataFrame:
    """Every row of ``points`` with every row of ``intervals`` of the same ``keys`` that holds its ``point``, ends included.
    Null keys, points and ends match nothing. Columns are those of a join on ``keys``."""
    cut = intervals.select("*", F.inline(whole_blocks(F.col(start), F.col(end))))
    longest = intervals.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long") + 1).alias(_LONGEST)).scalar()
    at = F.col(point).cast("long")
    blocks = [_named(size)(F.shiftright(at, 3 * size)) for size in range(SIZES)]
    # no interval has a block longer than itself
    sizes = F.array(*[F.lit(8**size).cast("long") for size in range(SIZES)])
    used = F.slice(F.array(*blocks), F.lit(1), F.size(F.filter(sizes, lambda s: s <= F.col(_LONGEST))))
    seen = points.withColumn(_LONGEST, F.coalesce(longest, F.lit(0).cast("long")))
    seen = seen.select(*points.columns, F.inline(used))
    return seen.join(cut, [*keys, _SIZE, _BLOCK]).drop(_SIZE, _BLOCK)
