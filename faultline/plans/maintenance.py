"""Sinks and table maintenance on the supplied tables."""

from pyspark.sql import functions as F

from faultline.plans.registry import VIEWS, query
from faultline.session import shared_folder
from faultline.sinks import tables as k
from faultline.sinks.buckets import BucketTable

VIEWS["v_target"] = "SELECT o_orderkey AS id, o_custkey AS author, o_orderdate AS stamp, o_totalprice AS value FROM {orders} WHERE o_orderstatus <> 'O'"
VIEWS["v_incoming"] = """
SELECT o_orderkey AS id, o_custkey AS author, o_orderdate + INTERVAL '1' DAY AS stamp, o_totalprice + 1 AS value FROM {orders} WHERE o_orderstatus <> 'F'"""


@query("q_write_readback", "SELECT id, author, stamp, value, 0 AS copy FROM {v_target} UNION ALL SELECT id, author, stamp, value, 1 FROM {v_target}")
def q_write_readback(t):
    """The same rows through CSV and, written once, through parquet."""
    rows = t.v_target
    csv, parquet = shared_folder(t.spark, "out-csv"), shared_folder(t.spark, "out-parquet")
    k.save(rows, csv, "csv", header=True)
    back = t.spark.read.schema("id bigint, author bigint, stamp timestamp_ntz, value double").option("header", "true").csv(csv)
    k.saved_once(t.spark, parquet, lambda: rows)
    again = k.saved_once(t.spark, parquet, lambda: rows.limit(0))
    return back.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))


@query(
    "q_insert_if_absent",
    "SELECT id, author, stamp, value FROM {v_incoming} WHERE id NOT IN (SELECT id FROM {v_target})",
)
def q_insert_if_absent(t):
    return k.inserted_if_absent(t.v_target, t.v_incoming, ["id"], ["stamp"])


@query(
    "q_upsert",
    """SELECT id, author, stamp, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stamp DESC, r DESC) AS rn FROM (
      SELECT *, 0 AS r FROM {v_target} UNION ALL SELECT *, 1 FROM {v_incoming})) WHERE rn = 1""",
)
def q_upsert(t):
    return k.upserted(t.v_target, t.v_incoming, ["id"], "stamp")


VIEWS["v_children"] = "SELECT l_orderkey AS parent, l_partkey AS child, l_quantity AS n FROM {lineitem} WHERE l_returnflag <> 'A'"
VIEWS["v_new_children"] = "SELECT l_orderkey AS parent, l_suppkey AS child, l_tax AS n FROM {lineitem} WHERE l_returnflag = 'A'"


@query(
    "q_replace_children",
    """SELECT * FROM {v_children} WHERE parent NOT IN (SELECT parent FROM {v_new_children}) UNION ALL SELECT * FROM {v_new_children}""",
)
def q_replace_children(t):
    return k.children_replaced(t.v_children, t.v_new_children, "parent")


@query(
    "q_soft_delete",
    """SELECT l_orderkey, l_partkey, CASE WHEN EXISTS (SELECT 1 FROM {v_new_children} c WHERE c.parent = l_orderkey AND c.child = l_suppkey) THEN 1 ELSE 0 END AS manual_delete
    FROM lineitem""",
)
def q_soft_delete(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("child"), F.col("l_orderkey").alias("parent"), F.lit(0).alias("manual_delete"))
    return k.soft_deleted(rows, t.v_new_children, ["parent", "child"]).select("l_orderkey", "l_partkey", "manual_delete")


@query("q_resume_anti", "SELECT o_orderkey AS id, o_custkey AS author FROM orders")
def q_resume_anti(t):
    """A first run does the finished orders, a second one everything: each id is worked on once."""
    path = shared_folder(t.spark, "resume")
    todo = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), "o_orderstatus")
    k.resume(todo.filter("o_orderstatus = 'F'"), "id", path, lambda d: d.select("id", "author"))
    k.resume(todo, "id", path, lambda d: d.select("id", "author"))
    return t.spark.read.parquet(path)


@query(
    "q_dead_letter",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome,
    CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS value FROM events""",
)
def q_dead_letter(t):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    parsed = F.try_parse_json(text)
    value = F.try_variant_get(parsed, "$.k", "bigint")
    error = F.when(parsed.isNull() & text.isNotNull(), F.lit("not JSON"))
    good, bad = k.split_failures(t.events.select("event_id", value.alias("v"), error.alias("e")), F.col("v"), F.col("e"), ["event_id"])
    return good.select("event_id", F.lit("ok").alias("outcome"), "value").unionByName(
        bad.select("event_id", F.lit("failed").alias("outcome"), F.lit(None).cast("bigint").alias("value"))
    )


@query(
    "q_bucket_upsert",
    """SELECT id, author, stamp, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stamp DESC, r DESC) AS rn FROM (
      SELECT *, 0 AS r FROM {v_target} UNION ALL SELECT *, 1 FROM {v_incoming})) WHERE rn = 1""",
)
def q_bucket_upsert(t):
    """The upsert on a table in buckets: touched buckets are written anew, the manifest last."""
    table = BucketTable.create(t.v_target, shared_folder(t.spark, "buckets"), ["id"], 16)
    table.upsert(t.v_incoming, "stamp")
    return table.read()


@query(
    "q_bucket_children",
    """SELECT * FROM {v_children} WHERE parent NOT IN (SELECT parent FROM {v_new_children}) UNION ALL SELECT * FROM {v_new_children}""",
)
def q_bucket_children(t):
    table = BucketTable.create(t.v_children, shared_folder(t.spark, "buckets"), ["parent"], 16)
    table.replace_children(t.v_new_children)
    return table.read()
