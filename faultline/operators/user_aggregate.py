"""Aggregates that a user writes in Python, combined before the shuffle.

An aggregate is four functions. Tasks update one state per key from the batches they read, so what travels is a state per
key and task, not the rows; equal keys meet sorted, and their states are merged one after the other while one is held.
A key that owns a third of all rows is updated by all tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

HELD_KEYS = 20_000


class Aggregate(NamedTuple):
    """``start()`` makes a state, ``update(state, array, ...)`` takes a batch of a key's values, ``merge(a, b)`` joins two
    states, ``finish(state)`` gives the result or None. States are pickled and should have a bounded size; as batches
    come in any order, update and merge must not depend on it."""

    start: Callable[[], Any]
    update: Callable[..., Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


def user_aggregate(df: DataFrame, keys: Sequence[str], values: Sequence[str], aggregate: Aggregate, name: str = "value", returns: str = "double") -> DataFrame:
    """One row per key with ``name``. Rows with a null among ``values`` are left out, and with them keys that have no other
    row; null keys are a key. Keys cannot be floating-point numbers."""
    if not keys or not values:
        raise ValueError("keys and values are needed")
    kinds = [df.schema[k] for k in keys]
    if any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in kinds):
        raise ValueError("floating-point keys")
    start, update, merge, finish = aggregate  # plain functions travel to workers that lack this package
    ids, held_keys = [f"k{i}" for i in range(len(keys))], HELD_KEYS
    cells = [f"v{i}" for i in range(len(values))]
    keyed = T.StructType([T.StructField(i, f.dataType) for i, f in zip(ids, kinds)])
    partial = T.StructType([*keyed.fields, T.StructField("state", T.BinaryType())])
    result = T.StructType([*keyed.fields, T.StructField("out", T._parse_datatype_string(returns))])

    def rows_of(found: list[tuple], kinds: list[pa.DataType], last: pa.DataType | None, names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, last])], names)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in ids]
            lists = pa.Table.from_batches([batch]).group_by(ids).aggregate([(c, "list") for c in cells])
            groups = zip(*[lists.column(i).to_pylist() for i in ids])
            parts = [lists.column(f"{c}_list").combine_chunks() for c in cells]
            for at, key in enumerate(groups):
                state = states[key] if key in states else start()
                states[key] = update(state, *[np.asarray(p[at].values) for p in parts])
            if len(states) > held_keys:
                yield rows_of([(*k, pickle.dumps(s)) for k, s in states.items()], kinds, pa.binary(), [*ids, "state"])
                states = {}
        if states:
            yield rows_of([(*k, pickle.dumps(s)) for k, s in states.items()], kinds, pa.binary(), [*ids, "state"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in ids]
            done = []
            for key, packed in zip(zip(*[batch.column(i).to_pylist() for i in ids]), batch.column("state").to_pylist()):
                part = pickle.loads(packed)
                if key == now:
                    state = merge(state, part)
                    continue
                if now is not None:
                    done.append((*now, finish(state)))
                now, state = key, part
            if done:
                yield rows_of(done, kinds, None, [*ids, "out"])
        if now is not None:
            yield rows_of([(*now, finish(state))], kinds, None, [*ids, "out"])

    there = df.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], *[F.col(v).alias(c) for v, c in zip(values, cells)]).dropna(subset=cells)
    states = there.mapInArrow(collect, partial)
    met = states.repartition(*ids).sortWithinPartitions(*ids)
    out = met.mapInArrow(combine, result)
    return out.select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], F.col("out").alias(name))


def median_of_means(blocks: int = 8) -> Aggregate:
    """Of (value, whole number): means of the values in blocks by the number's remainder, and the median of these means."""

    def update(state: np.ndarray, value: np.ndarray, number: np.ndarray) -> np.ndarray:
        at = number.astype(np.int64) % blocks
        return state + np.stack([np.bincount(at, minlength=blocks), np.bincount(at, value.astype(float), blocks)])

    def finish(state: np.ndarray) -> float:
        full = state[0] > 0
        return float(np.median(state[1, full] / state[0, full]))

    return Aggregate(lambda: np.zeros((2, blocks)), update, lambda a, b: a + b, finish)
