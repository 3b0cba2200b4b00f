"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(col: Column | str, name: str) -> Column:
    """Rounded to six places, the precision results are compared at."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6).alias(name)


def big(col: Column | str, name: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint").alias(name)
