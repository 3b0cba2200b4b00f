"""Running values against plain windows, on keys that own most of the rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from faultline.operators import scan as s
from faultline.operators.quantiles import exact_quantiles, median_and_mad


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(1)
    data = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 40)}"
        value = None if rnd.random() < 0.3 else rnd.randint(-5, 50)
        data.append((key, rnd.randint(0, 200), i, value))
    return spark.createDataFrame(data, "key string, day int, id int, v int").repartition(5).cache()


@pytest.mark.parametrize("partitions", [1, 3, 16])
@pytest.mark.parametrize("keys", [["key"], []])
def test_equals_window(skewed, rows, keys, partitions):
    w = Window.partitionBy(*keys).orderBy("day", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "id",
        F.row_number().over(w).alias("rn"),
        F.sum("v").over(upto).alias("total"),
        F.max("v").over(upto).alias("most"),
        F.last("v", ignorenulls=True).over(upto).alias("latest"),
        F.lag("v").over(w).alias("before"),
        F.lead("v").over(w).alias("after"),
    )
    got = s.ordered_scan(
        skewed, keys, ["day", "id"],
        {
            "rn": s.row_number(), "total": s.running_sum("v"), "most": s.running_max("v"),
            "latest": s.last_value("v"), "before": s.previous("v"), "after": s.following("v"),
        },
        partitions=partitions,
    ).select("id", "rn", "total", "most", "latest", "before", "after")
    assert rows(got) == rows(want)


def test_descending_order_and_null_keys(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, v int")
    got = s.ordered_scan(df, ["k"], [s.falling("v")], {"rn": s.row_number()}, partitions=3)
    assert rows(got, "v", "rn") == [(1, 2), (2, 1), (3, 2), (4, 1)]


def test_hot_key_is_spread(skewed):
    """The key that owns most rows sits in several partitions of the placed rows."""
    got = s.ordered_scan(skewed, ["key"], ["day", "id"], {"rn": s.row_number()}, partitions=8)
    assert got.filter("key = 'hot'").agg(F.max("rn")).first()[0] == skewed.filter("key = 'hot'").count()


@pytest.mark.parametrize("partitions", [1, 7])
def test_totals_per_key(skewed, rows, partitions):
    df = skewed.withColumn("key", F.when(F.col("key") != "k1", F.col("key")))
    w = Window.partitionBy("key")
    want = df.select("id", F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("total"))
    got = s.ordered_scan(df, ["key"], ["day", "id"], {"rn": s.row_number()}, totals={"n": s.row_number(), "total": s.running_sum("v")}, partitions=partitions)
    assert rows(got, "id", "n", "total") == rows(want)


FALLING = {
    "v": "int", "big": "bigint", "d": "date", "ts": "timestamp", "tn": "timestamp_ntz", "x": "double", "m": "decimal(9,2)", "b": "boolean",
}


@pytest.mark.parametrize("column", FALLING)
def test_falling_order_of_every_type(spark, rows, column):
    """Nulls last, NaN first, as in a window; ids break ties."""
    from faultline.operators.scan import falling

    df = spark.range(60).selectExpr(
        "id", "CASE WHEN id % 7 = 0 THEN null ELSE cast(id * 37 % 11 - 5 AS int) END AS v"
    ).selectExpr(
        "id", "v", "cast(v AS bigint) * 5000000000 AS big", "date_add(DATE '1970-01-03', v) AS d",
        "timestamp_seconds(v * 1.5) AS ts", "cast(timestamp_seconds(v * 1.5) AS timestamp_ntz) AS tn",
        "CASE v WHEN 3 THEN double('NaN') WHEN 4 THEN double('inf') ELSE v / 3.0 END AS x", "cast(v / 4.0 AS decimal(9,2)) AS m", "v > 0 AS b",
    )
    want = df.select("id", F.row_number().over(Window.orderBy(F.col(column).desc(), "id")).alias("rn"))
    got = s.ordered_scan(df, [], [falling(column), "id"], {"rn": s.row_number()}, partitions=5)
    assert rows(got, "id", "rn") == rows(want, "id", "rn")


def test_no_falling_order_of_texts(spark):
    with pytest.raises(TypeError):
        s.ordered_scan(spark.sql("SELECT 'a' AS k"), [], [s.falling("k")], {"rn": s.row_number()})


@pytest.mark.parametrize("partitions", [2, 9, 40])
def test_few_rows_and_one_key_in_all_parts(spark, rows, partitions):
    df = spark.sql("SELECT 'k' AS key, id AS day, id, cast(id AS int) AS v FROM range(7)").union(spark.sql("SELECT null, 1, 99, 4"))
    got = s.ordered_scan(df, ["key"], ["day", "id"], {"t": s.running_sum("v"), "p": s.previous("v"), "n": s.following("v")},
                         partitions=partitions, totals={"all": s.running_sum("v")})
    assert rows(got, "id", "t", "p", "n", "all") == [
        *[(i, i * (i + 1) // 2, i - 1 if i else None, i + 1 if i < 6 else None, 21) for i in range(7)], (99, 4, None, None, 4)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert s.ordered_scan(df, ["k"], ["v"], {"rn": s.row_number()}).count() == 0


def test_quantiles_equal_percentile(skewed, rows):
    want = skewed.groupBy("key").agg(
        F.percentile("v", 0.25).alias("q1"), F.median("v").alias("med"), F.percentile("v", 0.9).alias("p90")
    )
    got = exact_quantiles(skewed, ["key"], "v", {"q1": 0.25, "med": 0.5, "p90": 0.9})
    near = lambda rs: [(r[0], *[round(v, 9) for v in r[1:]]) for r in rs]
    assert near(rows(got, "key", "q1", "med", "p90")) == near(rows(want, "key", "q1", "med", "p90"))


def test_median_and_mad(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (4,), (9,)], "v int")
    r = median_and_mad(df, [], "v").first()
    assert (r["median"], r["mad"]) == (2.0, 1.0)


def test_rows_are_moved_once_and_nothing_is_written(spark):
    """One exchange carries the rows; the others carry the sample's count and quantiles, cut keys, and totals of border keys."""
    from tests.test_plans import plan

    df = spark.range(5000).selectExpr("id % 3 AS key", "id % 100 AS day", "id", "cast(id AS string) AS wide")
    spark.sparkContext.setJobGroup("scan", "planning")
    out = s.ordered_scan(df, ["key"], ["day", "id"], {"rn": s.row_number(), "p": s.previous("id")}, totals={"n": s.row_number()}, partitions=6)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("scan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    text = plan(spark, out)
    moved = [block for block in text.split("\n\n") if "Exchange" in block.split("\n")[0] and "wide" in block]
    assert len(moved) == 1 and "shufflepartitionidpassthrough" in moved[0]
    assert "rangepartitioning" not in text and "ExistingRDD" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
