"""Query and oracle registration."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# name -> SQL text; {x} names a supplied table or an earlier view
VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view as a DataFrame (the same SQL text as the oracle uses)."""
    text = VIEWS[name]
    return spark.sql(text, **{n: _source(spark, sf_dir, n) for n in _names(text)})


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name) if name in TABLES else view(spark, sf_dir, name)


def _closure(names: list[str], seen: dict[str, None]) -> None:
    for n in names:
        if n in VIEWS and n not in seen:
            _closure(_names(VIEWS[n]), seen)
            seen[n] = None


def oracle_text(sql: str) -> str:
    """Expand the views named in ``sql`` into common table expressions."""
    needed: dict[str, None] = {}
    _closure(_names(sql), needed)
    ctes = ",\n".join(f"{n} AS ({_plain(VIEWS[n])})" for n in needed)
    body = _plain(sql).strip()
    if not ctes:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if recursive:
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _plain(sql: str) -> str:
    return re.sub(r"\{([a-z]\w*)\}", r"\1", sql)


def oracles() -> dict[str, str]:
    """Oracle texts with their views written out; call it after all query modules are loaded."""
    return {name: oracle_text(sql) for name, sql in ORACLES.items()}


class Inputs:
    """Tables and stand-in views of one scale-factor folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return _source(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with an optional oracle."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
