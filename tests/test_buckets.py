"""Bucketed tables: only touched buckets are rewritten, versions stay, a step run again counts once."""

import pytest
from pyspark.sql import functions as F

from faultline.session import shared_folder
from faultline.sinks import tables
from faultline.sinks.buckets import BucketTable

SCHEMA = "id long, stamp int, value string"


def made(spark, n=200, buckets=16):
    rows = spark.createDataFrame([(i, 1, f"v{i}") for i in range(n)], SCHEMA)
    return rows, BucketTable.create(rows, shared_folder(spark, "bucketed"), ["id"], buckets)


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_upsert_leaves_other_buckets_alone(spark, rows):
    first, table = made(spark)
    before = files(table.read())
    changes = spark.createDataFrame([(3, 0, "old"), (4, 1, "tie"), (5, 2, "new"), (900, 1, "more"), (900, 2, "most")], "id int, stamp int, value string")
    assert table.upsert(changes, "stamp", ["value"]) == 1
    typed = changes.withColumn("id", F.col("id").cast("long"))
    assert rows(table.read(), "id", "stamp", "value") == rows(tables.upserted(first, typed, ["id"], "stamp", ["value"]), "id", "stamp", "value")
    kept = before & files(table.read())
    assert len(before) == 16 and 12 <= len(kept) < 16
    assert rows(table.read(0), "id", "stamp", "value") == rows(first, "id", "stamp", "value")
    near = table.near(spark.createDataFrame([(5,)], "id long"))
    assert len(files(near)) == 1 and near.filter("id = 5").first()["value"] == "new"


def test_children_and_soft_delete(spark, rows):
    old = spark.createDataFrame([(p, c, 0) for p in range(20) for c in range(5)], "parent long, child long, manual_delete int")
    table = BucketTable.create(old, shared_folder(spark, "children"), ["parent"], 8)
    new = spark.createDataFrame([(3, 77, 0), (3, 78, 0), (50, 1, 0)], old.schema)
    table.replace_children(new)
    want = tables.children_replaced(old, new, "parent")
    assert rows(table.read(), *old.columns) == rows(want, *old.columns)
    marks = spark.createDataFrame([(3, 78), (4, 2), (4, 99)], "parent long, child long")
    table.soft_delete(marks, ["parent", "child"])
    assert rows(table.read(), *old.columns) == rows(tables.soft_deleted(want, marks, ["parent", "child"]), *old.columns)
    assert table.versions() == [0, 1, 2]


def test_a_step_run_again_counts_once(spark):
    _, table = made(spark, 10, 4)
    more = spark.createDataFrame([(1, 1, "x")], SCHEMA)
    added = lambda old, new: old.unionByName(new)
    assert table.apply(more, added, version=0) == table.apply(more, added, version=0) == 1
    assert table.read().count() == 11 and table.versions() == [0, 1]


def test_a_failed_change_leaves_the_table(spark):
    first, table = made(spark, 10, 4)
    broken = lambda old, new: old.withColumn("value", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        table.apply(first, broken)
    with pytest.raises(ValueError, match="other buckets"):
        table.apply(first.filter("id = 1"), lambda old, new: old.withColumn("id", F.col("id") + 1).unionByName(first))
    assert table.versions() == [0] and table.read().count() == 10


def test_empty_tables_null_keys_and_refusals(spark):
    none = spark.createDataFrame([], SCHEMA)
    table = BucketTable.create(none, shared_folder(spark, "empty"), ["id"], 4)
    assert table.read().columns == ["id", "stamp", "value"] and table.read().count() == 0
    assert table.upsert(none, "stamp") == 1 and table.read().count() == 0
    table.upsert(spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 1, None)], SCHEMA), "stamp")
    assert {tuple(r) for r in table.read().collect()} == {(None, 2, "b"), (1, 1, None)}
    with pytest.raises(ValueError):
        table.read(9)
    with pytest.raises(Exception):
        BucketTable.create(none, table.path, ["id"], 4)
    with pytest.raises(ValueError):
        BucketTable.create(none, shared_folder(spark, "x"), [], 4)


def test_forgotten_versions_go_and_needed_folders_stay(spark, rows):
    _, table = made(spark, 40, 4)
    for i in range(3):
        table.upsert(spark.createDataFrame([(1, 5 + i, "x")], SCHEMA), "stamp")
    want = rows(table.read(), "id", "stamp", "value")
    table.forget(2)
    assert table.versions() == [2, 3] and rows(table.read(), "id", "stamp", "value") == want
    assert table.read(2).filter("id = 1").first()["stamp"] == 6
    table.forget(5)
    assert table.versions() == [2, 3]
    with pytest.raises(ValueError):
        table.forget(0)
