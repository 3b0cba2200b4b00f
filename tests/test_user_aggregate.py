"""User aggregates against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import lifetimes as lt
from faultline.operators import user_aggregate as u


def rows_for(seed=1, n=3000):
    rnd = random.Random(seed)
    # key None and key 1 own most rows
    return [(rnd.choice([1, 1, 1, None, *range(20)]), rnd.choice("ab"), i, None if i % 17 == 0 else rnd.random()) for i in range(n)]


def loop(rows, blocks):
    groups = {}
    for k, s, i, v in rows:
        if v is not None:
            groups.setdefault((k, s), {}).setdefault(i % blocks, []).append(v)
    return {k: float(np.median([np.mean(v) for v in g.values()])) for k, g in groups.items()}


@pytest.mark.parametrize("held", [20_000, 3])
def test_median_of_means_equals_the_loop(spark, monkeypatch, held):
    monkeypatch.setattr(u, "HELD_KEYS", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    rows = rows_for()
    df = spark.createDataFrame(rows, "k int, s string, i long, v double").repartition(6)
    got = {(r["k"], r["s"]): r["mom"] for r in u.user_aggregate(df, ["k", "s"], ["v", "i"], u.median_of_means(5), "mom").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = loop(rows, 5)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_rows_are_combined_before_they_move(spark):
    df = spark.range(100_000, numPartitions=4).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    seen = u.Aggregate(lambda: 0, lambda s, v: s + len(v), lambda a, b: a + b * 1_000_000, lambda s: s)
    got = [r["n"] for r in u.user_aggregate(df, ["k"], ["v"], seen, "n", "long").collect()]
    assert len(got) == 3
    # a state of some 8333 rows, and the other three tasks' states merged into it
    assert all(s % 1_000_000 in (8333, 8334) and s // 1_000_000 in range(24_999, 25_003) for s in got)


def test_empty_tables_and_refusals(spark):
    df = spark.createDataFrame([], "k int, v double, i long")
    assert u.user_aggregate(df, ["k"], ["v", "i"], u.median_of_means()).collect() == []
    nulls = spark.createDataFrame([(1, None, 2)], "k int, v double, i long")
    assert u.user_aggregate(nulls, ["k"], ["v", "i"], u.median_of_means()).collect() == []
    with pytest.raises(ValueError):
        u.user_aggregate(df, ["v"], ["k"], u.median_of_means())
    with pytest.raises(ValueError):
        u.user_aggregate(df, [], ["v"], u.median_of_means())


def test_a_trend_takes_a_user_aggregate(spark):
    df = spark.createDataFrame([(2000, float(i)) for i in range(30)] + [(2001, 1.0)], "y int, v double")
    spread = u.Aggregate(lambda: (np.inf, -np.inf), lambda s, v: (min(s[0], v.min()), max(s[1], v.max())), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: float(s[1] - s[0]))
    assert [tuple(r) for r in lt.yearly(df, "y", "v", 20, spread).select("y", "n", "value").collect()] == [(2000, 30, 29.0)]
