"""Two-pass external shuffle into shards.

Pass 1 scatters the records by a seeded hash of id, text and the number of the repeat into buckets that fit in memory, so
that repeated records scatter like any others. Pass 2 permutes every bucket by a seeded
Fisher-Yates shuffle. A record's place in the whole shuffled order is the number of records in earlier buckets plus its
place in its own; places are dealt to the shards in turn, so shard sizes differ by one record at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from faultline.llm.bloom import bit_table, may_hold
from faultline.llm.storage import stored


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n); every one of them is equally likely over the seeds."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # numpy swaps as Fisher and Yates do
    return order


def _permuted(seed: int):
    def run(rows: pa.Table, before: pa.Table) -> pa.Table:
        # a fixed order first: the permutation must not depend on how rows arrived
        rows = rows.sort_by([("tie", "ascending"), ("tie2", "ascending")])
        bucket, offset = before["bucket"][0].as_py(), before["before"][0].as_py()
        rows = rows.take(pa.array(fisher_yates(rows.num_rows, seed, bucket)))
        place = pa.array(np.arange(offset, offset + rows.num_rows))
        return rows.select(["rec"]).append_column("place", place)

    return run


def _picked(table: np.ndarray, held: bool):
    """The rows whose key the bit table lets through, or (not ``held``) the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(table, batch.column("key").to_numpy()) == held))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``task`` and ``nth``: how many rows of this task with the same key came before."""
    task, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        keys = batch.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(keys)))
        before = np.array([seen.get(int(k), 0) for k in keys[order[first]]], np.int64)
        nth = np.empty(len(keys), np.int64)
        nth[order] = np.arange(len(keys)) - np.repeat(first - before, many)
        seen.update(zip(keys[order[first]].tolist(), (before + many).tolist()))
        cols = [*batch.columns, pa.array(np.full(len(keys), task, np.int64)), pa.array(nth)]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "task", "nth"])


def numbered(marked: DataFrame) -> DataFrame:
    """``marked`` with ``nth``: 0, 1, ... among the rows of a key.

    Only rows of keys that repeat are written and joined. A task counts its own rows of a key; what earlier tasks hold of
    it is added by a join on (key, task), so that no key gathers in one task."""
    repeated = stored(marked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "repeated")
    many = repeated.count()
    if not many:
        return marked.withColumn("nth", F.lit(0).cast("long"))
    table = bit_table(repeated, "key", many)
    once = marked.mapInArrow(_picked(table, False), marked.schema).withColumn("nth", F.lit(0).cast("long"))
    schema = StructType([*marked.schema.fields, StructField("task", LongType()), StructField("nth", LongType())])
    rows = stored(marked.mapInArrow(_picked(table, True), marked.schema).mapInArrow(_counted, schema), "repeats")
    held = rows.groupBy("key", "task").agg(F.count(F.lit(1)).alias("n"))
    # one row per key and task
    earlier = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select("key", "task", F.sum("n").over(earlier).alias("before")).filter("before > 0")
    placed = rows.join(offset, ["key", "task"], "left").withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0)))
    return once.unionByName(placed.select(*once.columns))


def external_shuffle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 17,
                     bucket_bytes: int = 24 << 20) -> DataFrame:
    """All columns of ``docs`` as the struct ``rec``, and ``place``: 0, 1, ... in a uniformly random order.

    The order depends on the records, ``seed`` and ``bucket_bytes`` only. Rows equal in id and text are interchangeable,
    are numbered and scatter independently of each other.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 64
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    rows = numbered(docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec")))
    tie = F.xxhash64(F.lit(seed), "key", "nth")
    marked = rows.select(F.pmod(tie, F.lit(buckets)).alias("bucket"), tie.alias("tie"), F.col("key").alias("tie2"), "rec")
    counts = rows.select(F.pmod(tie, F.lit(buckets)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket, so per bucket_bytes of text
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    schema = StructType([marked.schema["rec"], StructField("place", LongType())])
    return marked.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInArrow(_permuted(seed), schema)


def shuffle_into_shards(docs: DataFrame, shards: int = 24, text_col: str = "text", id_col: str = "doc_id",
                        seed: int = 17, bucket_bytes: int = 24 << 20) -> DataFrame:
    """Columns of ``docs`` plus ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... without gaps inside a shard).

    Every record of the input is in the result exactly once, repeated rows too; shard sizes differ by one at most. Nulls
    and texts of any length are carried as they are; a record larger than a bucket has a bucket of its own size. An
    empty table gives an empty result. Input columns called ``shard`` or ``slot`` are replaced.
    """
    out = external_shuffle(docs, text_col, id_col, seed, bucket_bytes)
    kept = [F.col("rec").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return out.select(
        *kept, F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write the shards as folders ``shard=k`` with rows in order of slot, in one or more files of consecutive slots."""
    part = F.pmod(F.col("slot"), F.lit(files_per_shard))
    (
        sharded.repartition(F.col("shard"), part).sortWithinPartitions("shard", part, "slot")
        .write.partitionBy("shard").parquet(path)
    )
