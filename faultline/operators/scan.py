"""Running values over ordered rows, for keys of any size.

A window function puts every row of a key into one task. That does not hold when one author, one
file or one model owns a third of the rows. Here rows are dealt by a part number on the whole (key, order) tuple, so
a heavy key is cut into many even parts. Each part computes its own running values; what earlier parts contribute is
added from a small table. Only a key that crosses a border needs such an addition, and at most two keys of
a part do, so that table has at most two rows per part and is broadcast with that bound.

The part number follows from cut tuples, quantiles of a hashed sample that a scalar subquery takes; a row finds its
part by search among them. So a row's part depends on the data alone, and the rows are moved once, straight to the
window: nothing is written in between, no job runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

_PART, _CUTS, _KEY = "_part", "_cuts", "_tuple"
SAMPLES_PER_PART = 64
FAN = 8
# kind -> how the totals of earlier parts combine
_ADDITIVE = ("count", "sum")


class Falling(NamedTuple):
    """A column in falling order."""

    column: Column | str


def falling(column: Column | str) -> Falling:
    return Falling(column)


def row_number() -> tuple[str, Column]:
    """1-based position inside the key."""
    return "count", F.lit(1)


def running_sum(col: Column | str) -> tuple[str, Column]:
    return "sum", F.col(col) if isinstance(col, str) else col


def running_max(col: Column | str) -> tuple[str, Column]:
    return "max", F.col(col) if isinstance(col, str) else col


def last_value(col: Column | str) -> tuple[str, Column]:
    """Latest non-null value up to and with the current row."""
    return "last", F.col(col) if isinstance(col, str) else col


def previous(col: Column | str) -> tuple[str, Column]:
    """Value of the row just before the current one."""
    return "lag", F.col(col) if isinstance(col, str) else col


def following(col: Column | str) -> tuple[str, Column]:
    """Value of the row just after the current one."""
    return "lead", F.col(col) if isinstance(col, str) else col


def _rising(df: DataFrame, entry: Column | str | Falling) -> list[Column]:
    """Columns whose rising order is the order wanted; falling orders have nulls last."""
    if not isinstance(entry, Falling):
        return [F.col(entry) if isinstance(entry, str) else entry]
    col = F.col(entry.column) if isinstance(entry.column, str) else entry.column
    kind = df.select(col).schema[0].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        turned = [F.bitwise_not(col)]
    elif isinstance(kind, T.DateType):
        turned = [F.bitwise_not(F.unix_date(col))]
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        turned = [F.bitwise_not(F.unix_micros(col.cast("timestamp")))]
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        turned = [~F.isnan(col), -col]
    elif isinstance(kind, T.DecimalType):
        turned = [-col]
    elif isinstance(kind, T.BooleanType):
        turned = [~col]
    else:
        raise TypeError(f"no falling order for {kind.simpleString()}")
    return [col.isNull(), *turned]


def _with_part(rows: DataFrame, cuts: Column, n: int) -> DataFrame:
    """``rows`` with their part: the number of cuts that are not behind the row, searched ``FAN`` ways a step. The
    comparisons are written out, so they are compiled with the rest of the stage."""
    step = 1
    while step * FAN < n:
        step *= FAN
    found = rows.withColumn(_CUTS, cuts).withColumn(_PART, F.lit(0))
    while step:
        behind = [F.get(_CUTS, F.col(_PART) + (j * step - 1)) <= F.col(_KEY) for j in range(1, FAN)]
        more = reduce(lambda a, b: a + b, [F.when(c, step).otherwise(0) for c in behind])
        found = found.withColumn(_PART, F.col(_PART) + more)
        step //= FAN
    return found.drop(_CUTS)


def _cut_tuples(tuples: DataFrame, n: int) -> Column:
    """``n`` - 1 quantiles of the tuples, from about ``SAMPLES_PER_PART`` tuples a part, chosen by their hash."""
    rows = tuples.agg(F.count(F.lit(1)).alias("n")).scalar()
    chance = F.lit(float(n * SAMPLES_PER_PART)) / F.greatest(rows, F.lit(1))
    drawn = F.pmod(F.xxhash64(F.lit(7), _KEY), F.lit(1 << 30)) < chance * (1 << 30)
    found = tuples.filter(drawn).agg(F.array_sort(F.collect_list(_KEY)).alias("s"))
    place = lambda i: F.ceil(i * F.size("s") / n).cast("int") - 1
    cuts = F.transform(F.sequence(F.lit(1), F.lit(max(1, n - 1))), lambda i: F.get("s", F.greatest(place(i), F.lit(0))))
    none = F.slice("s", 1, 0)
    return found.select(F.when((F.size("s") > 0) & F.lit(n > 1), cuts).otherwise(none)).scalar()


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str | Falling],
    outputs: dict[str, tuple[str, Column]],
    partitions: int | None = None,
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add running columns to ``df``.

    ``order`` must be total inside a key (end it with an id). Columns of ``df`` are kept; each entry
    of ``outputs`` adds one. Keys may be empty, which gives one global order. ``totals`` adds counts
    or sums over the whole key. ``df`` is read for the sample, for the totals of keys that cross a border, and for the
    rows; write it first if it is dear.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, totals = list(keys), totals or {}
    kept = list(df.columns)
    inputs = [col.alias(f"_in_{name}") for name, (_, col) in {**outputs, **totals}.items()]
    by = [c for entry in order for c in _rising(df, entry)]
    key = F.struct(*[c.alias(f"c{i}") for i, c in enumerate([*map(F.col, keys), *by])]).alias(_KEY)
    cuts = _cut_tuples(df.select(key), n)
    rows = df.select("*", *inputs, key)
    # inputs follow from the columns that move anyway
    placed = _with_part(df.select("*", key), cuts, n).drop(_KEY).repartitionById(n, _PART).select("*", *inputs)

    local = Window.partitionBy(_PART, *keys).orderBy(*by)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(_PART, *keys)
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(1, Window.unboundedFollowing)

    local_cols, sums, carried, merged = [], [], [], []
    for name, (kind, _) in outputs.items():
        src, loc, tot, add = F.col(f"_in_{name}"), f"_loc_{name}", f"_tot_{name}", f"_add_{name}"
        t = F.col(tot)
        if kind == "count":
            local_cols.append(F.row_number().over(local).cast("bigint").alias(loc))
            sums.append(F.count(F.lit(1)).alias(tot))
        elif kind == "sum":
            local_cols.append(F.sum(src).over(upto).alias(loc))
            sums.append(F.sum(src).alias(tot))
        elif kind == "max":
            local_cols.append(F.max(src).over(upto).alias(loc))
            sums.append(F.max(src).alias(tot))
        elif kind == "last":
            local_cols.append(F.last(src, ignorenulls=True).over(upto).alias(loc))
            sums.append(F.max_by(src, F.when(src.isNotNull(), F.col(_KEY))).alias(tot))
        elif kind == "lag":
            local_cols.append(F.lag(F.struct(src.alias("v"))).over(local).alias(loc))
            sums.append(F.max_by(F.struct(src.alias("v")), F.col(_KEY)).alias(tot))
        elif kind == "lead":
            local_cols.append(F.lead(F.struct(src.alias("v"))).over(local).alias(loc))
            sums.append(F.min_by(F.struct(src.alias("v")), F.col(_KEY)).alias(tot))
        else:
            raise ValueError(f"unknown running value: {kind}")

        if kind in _ADDITIVE:
            carried.append(F.sum(t).over(earlier).alias(add))
            # a sum over nulls only stays null, as it does in a window
            merged.append(
                F.when(F.col(add).isNull(), F.col(loc))
                .when(F.col(loc).isNull(), F.col(add))
                .otherwise(F.col(loc) + F.col(add))
                .alias(name)
            )
        elif kind == "max":
            carried.append(F.max(t).over(earlier).alias(add))
            merged.append(F.greatest(F.col(loc), F.col(add)).alias(name))
        else:
            if kind == "lead":
                carried.append(F.first(t, ignorenulls=True).over(later).alias(add))
            else:
                carried.append(F.last(t, ignorenulls=True).over(earlier).alias(add))
            value = F.coalesce(F.col(loc), F.col(add))
            merged.append((value if kind == "last" else value["v"]).alias(name))
    for name, (kind, _) in totals.items():
        if kind not in _ADDITIVE:
            raise ValueError(f"no total of {kind}")
        total = F.count(F.lit(1)) if kind == "count" else F.sum(f"_in_{name}")
        local_cols.append(total.over(whole).alias(f"_loc_{name}"))
        sums.append(total.alias(f"_tot_{name}"))
        carried.append(F.sum(f"_tot_{name}").over(Window.partitionBy(*keys)).alias(f"_add_{name}"))
        merged.append(F.coalesce(f"_add_{name}", f"_loc_{name}").alias(name))

    crossing = rows
    names = [f"_key_{i}" for i in range(len(keys))]
    if keys:  # a key that crosses a border is that of a cut
        cut_keys = spark.range(1).select(F.explode(cuts).alias("c")).select(*[F.col(f"c.c{i}").alias(c) for i, c in enumerate(names)])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, names)])
        crossing = crossing.join(F.broadcast(cut_keys.distinct()), same, "left_semi")
    crossing = _with_part(crossing, cuts, n)
    groups = crossing.groupBy(_PART, *keys).agg(*sums).select(_PART, *keys, *carried)
    small = F.broadcast(groups.select(F.col(_PART).alias("_of"), *[F.col(k).alias(c) for k, c in zip(keys, names)], *[
        f"_add_{name}" for name in [*outputs, *totals]]))
    on = F.col(_PART) == F.col("_of")
    for k, c in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(c))
    return placed.select(*kept, _PART, *local_cols).join(small, on, "left").select(*kept, *merged)
