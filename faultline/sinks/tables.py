"""Sinks and table maintenance. Each function returns the new state of a table; writing it is one
``save``. Nothing is updated in place, so a retried task cannot apply a change twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from faultline.sources.files import path_exists


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: Sequence[str] = (), **options: str) -> None:
    writer = df.write.mode(mode).format(fmt).options(**options)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)


def saved_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built and written only when it is not there with its success mark."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        save(build(), path)
    return spark.read.parquet(path)


def inserted_if_absent(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` whose key the target lacks; of several with one key the first by ``order``, then by all columns."""
    rest = [c for c in new.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order, *rest)) if rest else F.first(F.lit(1))
    one = new.groupBy(*keys).agg(first.alias("_r"))
    one = one.select(*keys, "_r.*").select(*new.columns) if rest else one.select(*keys)
    return one.join(target.select(*keys), list(keys), "left_anti")


def upserted(target: DataFrame, changes: DataFrame, keys: Sequence[str], newest: str, ties: Sequence[str] = ()) -> DataFrame:
    """Target with the changes applied: the newest row of each key; a change beats a target row of
    the same age. The newest row is a maximum, so it is combined before the shuffle."""
    cols = [c for c in target.columns if c not in keys]
    both = target.withColumn("_rank", F.lit(0)).unionByName(changes.withColumn("_rank", F.lit(1)))
    best = F.max_by(F.struct(*cols), F.struct(newest, "_rank", *ties))
    return both.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*target.columns)


def children_replaced(target: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in ``new`` are replaced, all others stay."""
    parents = new.select(parent).distinct()
    return target.join(parents, parent, "left_anti").unionByName(new.select(*target.columns))


def soft_deleted(target: DataFrame, corrections: DataFrame, keys: Sequence[str], flag: str = "manual_delete") -> DataFrame:
    """Sets the flag on the listed rows."""
    marks = corrections.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return target.join(marks, list(keys), "left").withColumn(
        flag, F.when(F.col("_hit") == 1, 1).otherwise(F.col(flag))
    ).drop("_hit")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run has not finished."""
    return todo.join(done.select(key), key, "left_anti")


def resume(todo: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Append the results of the rows ``path`` does not hold yet."""
    spark = todo.sparkSession
    if path_exists(spark, f"{path}/_SUCCESS"):
        todo = remaining(todo, spark.read.parquet(path), key)
    save(work(todo), path, mode="append")


def split_failures(df: DataFrame, value: Column, error: Column, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows with ``value`` and failed rows with ``error`` (null on good rows)."""
    judged = df.select(*keep, F.struct(value.alias("value"), error.alias("error")).alias("_r"))
    good = judged.filter(F.col("_r.error").isNull()).select(*keep, "_r.value")
    return good, judged.filter(F.col("_r.error").isNotNull()).select(*keep, "_r.error")


def guarded(function: Callable, returns: str):
    """A row function whose exception becomes text: struct<value, error>. For work only Python can
    do; anything a column expression can do belongs in ``split_failures``."""

    def run(v):
        try:
            return function(v), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    return F.udf(run, T.StructType.fromDDL(f"value {returns}, error string"), useArrow=True)
