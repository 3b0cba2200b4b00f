"""Exact quantiles by counting, without holding a group in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.scan import ordered_scan, running_sum


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per key.

    Equal values are counted first, then a running count finds the two neighbours of each quantile.
    ``probs`` maps output names to probabilities. Null values are left out.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = ordered_scan(
        counts, keys, ["_v"], {"_upto": running_sum("_n")}, totals={"_total": running_sum("_n")}
    )
    return _pick(placed, keys, probs)


def _pick(placed: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    def at(p: float, rounding) -> Column:
        index = rounding((F.col("_total") - 1) * F.lit(float(p)))
        return F.min(F.when(F.col("_upto") > index, F.col("_v")))

    aggs = [F.max("_total").alias("_total")]
    for name, p in probs.items():
        aggs += [at(p, F.floor).alias(f"_lo_{name}"), at(p, F.ceil).alias(f"_hi_{name}")]
    picked = placed.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, and median of the absolute distances to it, per key."""
    keys = list(keys)
    med = exact_quantiles(df, keys, value, {"median": 0.5})
    if keys:
        moved = df.join(med, keys)
    else:
        moved = df.withColumn("median", med.scalar())
    moved = moved.withColumn("_dist", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantiles(moved, keys, "_dist", {"mad": 0.5})
    if keys:
        return med.join(mad, keys)
    return mad.select(med.scalar().alias("median"), "mad")
