"""Vector operators on the embeddings table."""

from pyspark.sql import functions as F

from faultline.functions.columns import r6
from faultline.operators import vectors as v
from faultline.plans.registry import VIEWS, query

# a vector next to its successor; sides are missing at both ends of the table and for one label
VIEWS["v_vector_pairs"] = """
SELECT a.vec_id, a.label, a.embedding AS pre, CASE WHEN a.label = 3 THEN NULL ELSE b.embedding END AS post
FROM {embeddings} a LEFT JOIN {embeddings} b ON b.vec_id = a.vec_id + 1"""

VIEWS["o_vec_flat"] = """
SELECT vec_id, label, pos, CAST(pre[pos + 1] AS DOUBLE) AS a, CAST(coalesce(post[pos + 1], 0) AS DOUBLE) AS b FROM (
  SELECT *, unnest(range(len(pre))) AS pos FROM {v_vector_pairs})"""


def _rows(df, keys, vector):
    return df.select(*keys, F.posexplode(vector).alias("pos", "value")).select(*keys, "pos", r6("value", "value"))


@query(
    "q_vec_compare",
    """SELECT vec_id, CAST(pos AS INT) AS pos, round(a - b, 6) + 0 AS value FROM {o_vec_flat}
    UNION ALL SELECT vec_id, CAST(64 + pos AS INT), round(a + b, 6) + 0 FROM {o_vec_flat}
    UNION ALL SELECT vec_id, CAST(128 + pos AS INT), round(a * b, 6) + 0 FROM {o_vec_flat}
    UNION ALL SELECT vec_id, 192, round(sum(a * b) / (greatest(sqrt(sum(a * a)), 1e-8) * greatest(sqrt(sum(b * b)), 1e-8)), 6) + 0 FROM {o_vec_flat} GROUP BY vec_id""",
)
def q_vec_compare(t):
    out = t.v_vector_pairs.withColumn("c", v.compare(F.col("pre"), F.col("post")))
    return _rows(out, ["vec_id"], "c").withColumn("value", F.col("value") + 0)


_POOLED = "SELECT label, CAST(pos AS INT) AS pos, round({expr}, 6) AS value FROM {{o_vec_flat}} GROUP BY 1, 2"


def _oracle(expr):
    return _POOLED.format(expr=expr).replace("{{", "{").replace("}}", "}")


@query("q_vec_mean", _oracle("avg(a)"))
def q_vec_mean(t):
    return _rows(v.pool(t.embeddings, ["label"], "embedding", "mean"), ["label"], "vector")


@query("q_vec_max", _oracle("max(a)"))
def q_vec_max(t):
    return _rows(v.pool(t.embeddings, ["label"], "embedding", "max"), ["label"], "vector")


@query("q_vec_softmax", _oracle("sum(exp(a) * a) / sum(exp(a))"))
def q_vec_softmax(t):
    return _rows(v.pool(t.embeddings, ["label"], "embedding", "softmax"), ["label"], "vector")


@query(
    "q_vec_concat",
    """SELECT vec_id, CAST(pos AS INT) AS pos, round(a, 6) AS value FROM {o_vec_flat} UNION ALL SELECT vec_id, CAST(64 + pos AS INT), round(b, 6) FROM {o_vec_flat}""",
)
def q_vec_concat(t):
    out = t.v_vector_pairs.withColumn("c", v.concatenated(F.col("pre"), F.col("post"), 64))
    return _rows(out, ["vec_id"], "c")
