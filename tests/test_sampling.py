"""Splits are disjoint, complete and independent of the partitioning."""

import datetime

import pytest
from pyspark.sql import functions as F

from faultline.operators import dataset as ds
from faultline.operators import sampling as sp


@pytest.fixture(scope="module")
def commits(spark):
    day = datetime.datetime(2021, 1, 1)
    rows = [(i, day + datetime.timedelta(days=i % 50), int(i % 5 == 0)) for i in range(500)]
    return spark.createDataFrame(rows, "commit_id int, commit_date timestamp_ntz, label int")


def test_three_way_split(commits):
    out = ds.three_way_split(commits, 0.1, 0.2, seed=1).collect()
    assert len(out) == 500 and len({r["commit_id"] for r in out}) == 500
    sizes = {s: sum(r["split"] == s for r in out) for s in ("train", "validation", "test")}
    assert sizes == {"test": 100, "validation": 50, "train": 350}
    newest_train = max(r["commit_date"] for r in out if r["split"] != "test")
    assert newest_train <= min(r["commit_date"] for r in out if r["split"] == "test")


def test_choice_does_not_depend_on_partitions(commits, rows):
    a = rows(ds.random_split(commits.repartition(1), 0.3, 5))
    b = rows(ds.random_split(commits.repartition(13), 0.3, 5))
    assert a == b
    assert rows(sp.shuffled(commits.coalesce(1), "commit_id", 2)) == rows(sp.shuffled(commits.repartition(9), "commit_id", 2))
    assert a != rows(ds.random_split(commits, 0.3, 6))


def test_undersample(commits):
    n = {r["label"]: r["n"] for r in sp.undersample(commits, "label", "commit_id", 1).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 100, 1: 100}


def test_balanced_batches(commits):
    got = sp.balanced_batches(commits, "label", "commit_id", 1).groupBy("batch", "label").count().collect()
    assert len(got) == 2 * (500 // 64 + 1)
    assert {r["count"] for r in got} == {32}


def test_balanced_epoch_has_no_repeats(commits):
    got = sp.balanced_epoch(commits, "label", "commit_id", 1)
    assert got.count() == got.select("commit_id").distinct().count() == 3 * 64


def test_fixed_batches(commits):
    keep = sp.fixed_batches(commits, ["commit_id"]).groupBy("batch").count().collect()
    drop = sp.fixed_batches(commits, ["commit_id"], keep_last=False).groupBy("batch").count().collect()
    assert len(keep) == 8 and min(r["count"] for r in keep) == 500 - 7 * 64
    assert {r["count"] for r in drop} == {64} and len(drop) == 7


def test_quota_is_capped_by_what_there_is(spark, commits):
    pool = commits.withColumn("month", F.month("commit_date"))
    quotas = spark.createDataFrame([(1, 5.0), (2, 10_000.0), (3, 0.0)], "month int, quota double")
    got = {r["month"]: r["n"] for r in sp.quota_sample(pool, quotas, ["month"], "commit_id", 1).groupBy("month").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 5, 2: pool.filter("month = 2").count()}


def test_folds_leave_the_rest_for_training(spark):
    df = spark.range(23).withColumnRenamed("id", "commit_id")
    got = {r["fold"]: r["count"] for r in ds.position_folds(df, ["commit_id"]).groupBy("fold").count().collect()}
    assert got == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, None: 3}


def test_safe_commits_exclude_vulnerable(spark, rows):
    v = spark.createDataFrame([(1, "2020"), (2, "2021")], "commit_id int, commit_date string")
    s = spark.createDataFrame([(2, "2021"), (3, "2019")], "commit_id int, commit_date string")
    assert rows(ds.combine_labelled(v, s), "commit_id", "label") == [(1, 1), (2, 1), (3, 0)]


def test_draws_with_replacement_cover_the_table(spark):
    df = spark.range(20).withColumnRenamed("id", "commit_id")
    got = sp.draw_with_replacement(df, 1000, "commit_id", 3)
    assert got.count() == 1000 and got.select("commit_id").distinct().count() == 20
