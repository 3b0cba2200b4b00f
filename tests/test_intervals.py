"""Points in intervals against a plain loop."""

import random

from pyspark.sql import functions as F

from faultline.operators import intervals as iv

POINTS, INTERVALS = "file string, line long, note int", "file string, lo int, hi int, name int"


def check(spark, points, intervals):
    out = iv.points_in_intervals(spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS), ["file"], "line", "lo", "hi")
    assert out.columns == ["file", "line", "note", "lo", "hi", "name"]
    got = sorted(tuple(r) for r in out.collect())
    want = sorted(
        (f, x, n, lo, hi, name) for f, x, n in points for g, lo, hi, name in intervals
        if None not in (f, x, g, lo, hi) and f == g and lo <= x <= hi
    )
    assert got == want
    return got


def test_random_nested_and_repeated(spark):
    rnd = random.Random(1)
    intervals = []
    for n in range(150):
        lo = rnd.randint(-700, 700)
        intervals.append((rnd.choice("ab"), lo, lo + rnd.choice([-1, 0, 1, 6, 7, 8, 63, 64, 500, 5000]), n))
    points = [(rnd.choice("ab"), rnd.randint(-900, 6000) if i % 3 else rnd.randint(-80, 80), i) for i in range(300)]
    assert check(spark, points + points[:20], intervals + intervals[:20])


def test_borders_of_blocks(spark):
    edges = [-65, -64, -9, -8, -1, 0, 1, 7, 8, 9, 63, 64, 511, 512, 2**31 - 1, -(2**31)]
    intervals = [("f", a, b, i) for i, (a, b) in enumerate((a, b) for a in edges for b in edges)]
    check(spark, [("f", x + d, 0) for x in edges for d in (-1, 0, 1)], intervals)


def test_nulls_and_empty_tables(spark):
    points = [("f", 3, 0), (None, 3, 1), ("f", None, 2), ("g", 3, 3)]
    assert len(check(spark, points, [("f", 1, 5, 0), (None, 1, 5, 1), ("f", None, 5, 2), ("f", 1, None, 3), ("f", 5, 1, 4)])) == 1
    for p, i in (([], [("f", 1, 5, 0)]), (points, []), ([], [])):
        assert check(spark, p, i) == []


def test_a_large_file_with_many_functions(spark):
    """100 000 lines and 10 000 functions of one file: one join on keys, no comparison of all with all."""
    lines = spark.range(100_000).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    functions = spark.range(10_000).select(F.lit("f").alias("file"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 11).alias("hi"))
    out = iv.points_in_intervals(lines, functions, ["file"], "line", "lo", "hi")
    row = out.agg(F.count("*").alias("n"), F.sum(F.col("line") - F.col("lo")).alias("s")).first()
    assert row["n"] == 12 * 10_000 - 2 and row["s"] == 66 * 10_000 - 21
    text = out._jdf.queryExecution().toString()
    assert "_block" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
