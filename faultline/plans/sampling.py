"""Seeded sampling on the supplied tables."""

from pyspark.sql import functions as F

from faultline.operators import sampling as s
from faultline.plans.registry import VIEWS, query

_NUM = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


@query(
    "q_shuffle",
    "SELECT commit_id, row_number() OVER (ORDER BY md5('7:' || commit_id), commit_id) AS position FROM {v_commits}",
)
def q_shuffle(t):
    return s.shuffled(t.v_commits.select("commit_id"), "commit_id", 7)


@query(
    "q_quota_sample",
    """WITH q AS (SELECT year(commit_date) AS y, month(commit_date) AS m, round_even(count(*) * 0.5, 0) AS quota
      FROM {v_vulnerable} GROUP BY 1, 2)
    SELECT commit_id, CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM (
      SELECT s.commit_id, q.y, q.m, q.quota, row_number() OVER (PARTITION BY q.y, q.m ORDER BY md5('3:' || s.commit_id), s.commit_id) AS rn
      FROM {v_safe} s JOIN q ON year(s.commit_date) = q.y AND month(s.commit_date) = q.m) WHERE rn <= quota""",
)
def q_quota_sample(t):
    bucket = lambda df: df.withColumn("year", F.year("commit_date")).withColumn("month", F.month("commit_date"))
    quotas = (
        bucket(t.v_vulnerable).groupBy("year", "month").agg(F.bround(F.count(F.lit(1)) * 0.5, 0).alias("quota"))
    )
    pool = bucket(t.v_safe).select("commit_id", "year", "month")
    return s.quota_sample(pool, quotas, ["year", "month"], "commit_id", 3).select("commit_id", "year", "month")


@query(
    "q_undersample",
    """SELECT commit_id, label FROM (SELECT commit_id, label, n,
      row_number() OVER (PARTITION BY label ORDER BY md5('42:' || commit_id), commit_id) AS rn,
      (SELECT min(c) FROM (SELECT count(*) AS c FROM {v_commits} GROUP BY label)) AS smallest
      FROM (SELECT *, 1 AS n FROM {v_commits})) WHERE rn <= smallest""",
)
def q_undersample(t):
    return s.undersample(t.v_commits.select("commit_id", "label"), "label", "commit_id", 42)


@query(
    "q_balanced_batches",
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM {v_commits}),
    d AS (SELECT unnest(range(CAST((floor(n / 64) + 1) * 64 AS BIGINT))) AS draw, n1, n0 FROM n),
    p AS (SELECT commit_id, label, row_number() OVER (PARTITION BY label ORDER BY commit_id) AS rn FROM {v_commits})
    SELECT CAST(floor(draw / 64) AS BIGINT) AS batch, CAST(draw % 64 AS INT) AS slot, p.label, p.commit_id FROM d
    JOIN p ON p.label = CASE WHEN draw % 64 < 32 THEN 1 ELSE 0 END
      AND p.rn = """
    + _NUM.format("'5:' || draw")
    + " % CASE WHEN draw % 64 < 32 THEN n1 ELSE n0 END + 1",
)
def q_balanced_batches(t):
    return s.balanced_batches(t.v_commits.select("commit_id", "label"), "label", "commit_id", 5)


@query(
    "q_balanced_epoch",
    """SELECT commit_id, label, CAST(floor((rn - 1) / 32) AS BIGINT) AS batch FROM (SELECT commit_id, label,
      row_number() OVER (PARTITION BY label ORDER BY md5('9:' || commit_id), commit_id) AS rn,
      (SELECT floor(min(c) / 32) FROM (SELECT count(*) AS c FROM {v_commits} GROUP BY label)) AS b FROM {v_commits})
    WHERE floor((rn - 1) / 32) < b""",
)
def q_balanced_epoch(t):
    return s.balanced_epoch(t.v_commits.select("commit_id", "label"), "label", "commit_id", 9)


@query(
    "q_batches",
    """SELECT commit_id, CAST(floor((row_number() OVER (ORDER BY commit_date, commit_id) - 1) / 64) AS BIGINT) AS batch
    FROM {v_commits}""",
)
def q_batches(t):
    rows = t.v_commits.select("commit_id", "commit_date")
    return s.fixed_batches(rows, ["commit_date", "commit_id"]).drop("commit_date")


@query(
    "q_sample_replacement",
    """WITH p AS (SELECT commit_id, row_number() OVER (ORDER BY commit_id) AS rn, count(*) OVER () AS n FROM {v_commits}),
    d AS (SELECT unnest(range(2000)) AS draw)
    SELECT d.draw, p.commit_id FROM d JOIN p ON p.rn = """
    + _NUM.format("'13:' || d.draw")
    + " % (SELECT count(*) FROM {v_commits}) + 1",
)
def q_sample_replacement(t):
    return s.draw_with_replacement(t.v_commits.select("commit_id"), 2000, "commit_id", 13)
