"""Vector columns: comparison and pooling of embeddings, as array expressions and grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def or_zeros(v: Column, other: Column) -> Column:
    """The vector, or zeros of the other side's length when it is missing."""
    return F.coalesce(v, F.transform(other, lambda _: F.lit(0.0)))


def compare(pre: Column, post: Column) -> Column:
    """Difference, sum, product and cosine of both sides, one after the other."""
    a = or_zeros(pre.cast("array<double>"), post)
    b = or_zeros(post.cast("array<double>"), pre)
    norm = lambda v: F.greatest(F.sqrt(_dot(v, v)), F.lit(1e-8))
    cosine = _dot(a, b) / (norm(a) * norm(b))
    return F.concat(
        F.zip_with(a, b, lambda x, y: x - y),
        F.zip_with(a, b, lambda x, y: x + y),
        F.zip_with(a, b, lambda x, y: x * y),
        F.array(cosine),
    )


def concatenated(pre: Column, post: Column, size: int) -> Column:
    """Both sides as one vector; a missing side is zeros."""
    zeros = F.array_repeat(F.lit(0.0), size)
    side = lambda v: F.coalesce(v.cast("array<double>"), zeros)
    return F.concat(side(pre), side(post))


def pool(df: DataFrame, keys: Sequence[str], vector: str, how: str = "mean", out: str = "vector") -> DataFrame:
    """Mean, max or softmax-weighted mean of the vectors of a key, by position.

    Positions are aggregated before the shuffle, whatever the number of vectors of a key; the
    result is as long as one vector.
    """
    keys = list(keys)
    flat = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("_p", "_x"))
    at = [*keys, "_p"]
    if how == "mean":
        cells = flat.groupBy(*at).agg(F.avg("_x").alias("_v"))
    elif how == "max":
        cells = flat.groupBy(*at).agg(F.max("_x").alias("_v"))
    elif how == "softmax":
        # one maximum per key keeps the exponent small; it cancels out position by position
        top = flat.groupBy(*at).agg(F.max("_x").alias("_m"))
        maxima = top.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_m"))).alias("_top"))
        shifted = flat.join(maxima, keys).withColumn("_e", F.exp(F.col("_x") - F.element_at("_top", F.col("_p"))))
        cells = shifted.groupBy(*at).agg((F.sum(F.col("_e") * F.col("_x")) / F.sum("_e")).alias("_v"))
    else:
        raise ValueError(f"unknown pooling: {how}")
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_v")))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c["_v"]).alias(out))
