"""Seeded hashes. A row's place depends on its id and the seed only, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_key(seed: int | str, *parts: Column) -> Column:
    """Hex text that orders rows at random for ``seed``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_number(seed: int | str, *parts: Column) -> Column:
    """Non-negative 60-bit number drawn from the hash."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 15), 16, 10).cast("bigint")
