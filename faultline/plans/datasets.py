"""Dataset building on the supplied tables."""

from pyspark.sql import functions as F

from faultline.functions.columns import big, r6
from faultline.operators import dataset as d
from faultline.operators.scan import falling
from faultline.plans.registry import VIEWS, query

VIEWS["v_vcc_link"] = """
SELECT CASE WHEN l.l_discount = 0 THEN NULL ELSE l.l_orderkey END AS vcc_sha, o.o_orderpriority AS config_code,
       CASE l.l_returnflag WHEN 'R' THEN 'manual' WHEN 'A' THEN 'automatic' ELSE 'advisory' END AS mapping_type,
       l.l_linestatus = 'F' AND l.l_tax > 0.05 AS determined_by_heuristic
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey"""

_KEEP = "vcc_sha IS NOT NULL AND NOT determined_by_heuristic AND mapping_type <> 'automatic'"


@query(
    "q_vcc_export",
    f"""SELECT config_code, vcc_sha AS commit_id, o_orderdate AS commit_date,
    string_agg(DISTINCT mapping_type, ',' ORDER BY mapping_type) AS sources
    FROM {{v_vcc_link}} LEFT JOIN orders ON o_orderkey = vcc_sha
    WHERE {_KEEP} AND o_orderpriority = config_code GROUP BY 1, 2, 3""",
)
def q_vcc_export(t):
    commits = t.orders.select(
        F.col("o_orderkey").alias("com_sha"),
        F.col("o_orderpriority").alias("com_config_code"),
        F.col("o_orderdate").alias("com_date"),
    )
    return d.contributing_commits(t.v_vcc_link, commits, d.heuristic_filter(False, ["automatic"]))


@query(
    "q_projects_having",
    f"""SELECT config_code, count(DISTINCT vcc_sha) AS num_vccs FROM {{v_vcc_link}} WHERE {_KEEP}
    GROUP BY 1 HAVING count(DISTINCT vcc_sha) >= 50""",
)
def q_projects_having(t):
    return d.projects_with_enough(t.v_vcc_link, 50, d.heuristic_filter(False, ["automatic"]))


@query(
    "q_anti_join",
    """SELECT commit_id, commit_date, project FROM {v_safe} s
    WHERE NOT EXISTS (SELECT 1 FROM {v_vulnerable} v WHERE v.commit_id = s.commit_id)""",
)
def q_anti_join(t):
    return d.without_known(t.v_safe, t.v_vulnerable)


VIEWS["o_labelled"] = """
SELECT commit_id, commit_date, project, 1 AS label FROM {v_vulnerable} UNION ALL
SELECT commit_id, commit_date, project, 0 FROM {v_safe} WHERE commit_id NOT IN (SELECT commit_id FROM {v_vulnerable})"""


@query("q_combine_labelled", "SELECT * FROM {o_labelled}")
def q_combine_labelled(t):
    return d.combine_labelled(t.v_vulnerable, t.v_safe)


def _labelled(t):
    return d.combine_labelled(t.v_vulnerable, t.v_safe)


@query(
    "q_left_join_dropna",
    """SELECT l.doc_id AS id, l.toxic AS label, s.lines FROM labels l LEFT JOIN {v_sizes} s ON l.doc_id = s.id
    WHERE s.lines IS NOT NULL""",
)
def q_left_join_dropna(t):
    labels = t.labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return labels.join(t.v_sizes, "id", "left").dropna(subset=["lines"])


VIEWS["v_first_half"] = """
SELECT o_orderkey AS commit_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS commit_date,
       o_orderpriority AS project, 'import' AS sources FROM {orders} WHERE o_orderstatus <> 'O'"""

VIEWS["v_second_half"] = """
SELECT o_orderkey AS commit_id, o_orderdate AS commit_date, o_orderpriority AS project, 'augmented' AS sources
FROM {orders} WHERE o_orderstatus <> 'F'"""


@query(
    "q_outer_coalesce",
    """SELECT coalesce(a.commit_id, b.commit_id) AS commit_id, coalesce(a.commit_date, b.commit_date) AS commit_date,
    coalesce(a.project, b.project) AS project, coalesce(a.sources, b.sources) AS sources
    FROM {v_first_half} a FULL JOIN {v_second_half} b ON a.commit_id = b.commit_id""",
)
def q_outer_coalesce(t):
    return d.outer_first_non_null(t.v_first_half, t.v_second_half, "commit_id")


@query(
    "q_backfill_dates",
    """SELECT a.commit_id, coalesce(a.commit_date, o.o_orderdate) AS commit_date, a.project, a.sources,
    a.commit_date IS NULL AS was_missing FROM {v_first_half} a LEFT JOIN orders o ON o.o_orderkey = a.commit_id""",
)
def q_backfill_dates(t):
    known = t.orders.select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("commit_date"))
    return d.backfill(t.v_first_half, known, "commit_id", "commit_date")


VIEWS["v_membership"] = """
SELECT o_orderkey AS commit_id, CASE o_orderstatus WHEN 'F' THEN 'train' ELSE 'test' END AS split
FROM {orders} WHERE o_totalprice > 100000"""


@query(
    "q_split_membership",
    """SELECT c.commit_id, c.author, c.project, m.split FROM {v_commits} c JOIN {v_membership} m USING (commit_id)""",
)
def q_split_membership(t):
    rows = t.v_commits.select("commit_id", "author", "project")
    return d.split_by_membership(rows, t.v_membership, "commit_id")


@query(
    "q_align_inputs",
    "SELECT commit_id, author FROM {v_commits} WHERE commit_id IN (SELECT l_orderkey FROM lineitem)",
)
def q_align_inputs(t):
    other = t.lineitem.select(F.col("l_orderkey").alias("commit_id"))
    return d.aligned(t.v_commits.select("commit_id", "author"), other, "commit_id")


@query(
    "q_class_balance",
    """SELECT project, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
    round(100.0 * count(*) FILTER (label = 1) / count(*), 6) AS pct_pos,
    round(100.0 * count(*) FILTER (label = 0) / count(*), 6) AS pct_neg FROM {o_labelled} GROUP BY project""",
)
def q_class_balance(t):
    b = d.class_balance(_labelled(t))
    return b.select("project", "n_pos", "n_neg", r6("pct_pos", "pct_pos"), r6("pct_neg", "pct_neg"))


VIEWS["o_dated"] = """
SELECT *, row_number() OVER (ORDER BY commit_date DESC, commit_id) <= floor(count(*) OVER () * 0.2) AS is_test
FROM {o_labelled}"""

VIEWS["o_split"] = """
SELECT commit_id, commit_date, project, label, 'test' AS split FROM {o_dated} WHERE is_test UNION ALL
SELECT commit_id, commit_date, project, label,
  CASE WHEN row_number() OVER (ORDER BY md5('11:' || commit_id), commit_id) <= ceil(count(*) OVER () * (0.1 / (1.0 - 0.2)))
       THEN 'validation' ELSE 'train' END AS split FROM {o_dated} WHERE NOT is_test"""


@query("q_temporal_split", "SELECT commit_id, commit_date, label, is_test FROM {o_dated}")
def q_temporal_split(t):
    return d.temporal_split(_labelled(t), 0.2).select("commit_id", "commit_date", "label", "is_test")


@query("q_hash_split", "SELECT commit_id, label, split FROM {o_split}")
def q_hash_split(t):
    return d.three_way_split(_labelled(t), 0.1, 0.2, seed=11).select("commit_id", "label", "split")


@query(
    "q_split_rollup",
    """SELECT split, project, count(*) AS n, count(*) FILTER (label = 1) AS n_pos FROM {o_split}
    GROUP BY ROLLUP (split, project)""",
)
def q_split_rollup(t):
    return d.split_summary(d.three_way_split(_labelled(t), 0.1, 0.2, seed=11))


@query(
    "q_month_buckets",
    """SELECT CAST(year(commit_date) AS INT) AS year, CAST(month(commit_date) AS INT) AS month, count(*) AS n
    FROM {v_vulnerable} GROUP BY 1, 2""",
)
def q_month_buckets(t):
    return d.month_counts(t.v_vulnerable)


@query(
    "q_label_pivot",
    """SELECT CAST(year(commit_date) AS INT) AS year, CAST(month(commit_date) AS INT) AS month,
    count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1) AS n_pos,
    CAST(round_even(count(*) FILTER (label = 1) * 1.5 - count(*) FILTER (label = 0), 0) AS DOUBLE) AS to_add
    FROM {o_labelled} GROUP BY 1, 2""",
)
def q_label_pivot(t):
    m = d.month_deficit(_labelled(t), 1.5)
    return m.select("year", "month", "n_neg", "n_pos", F.col("to_add").cast("double").alias("to_add"))


@query(
    "q_augment_need",
    """SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
    CAST(trunc(count(*) FILTER (label = 1) * 2.5 - count(*) FILTER (label = 0) - 1) AS BIGINT) AS to_add FROM {o_labelled}""",
)
def q_augment_need(t):
    return d.safe_needed(_labelled(t), 2.5)


@query(
    "q_except_subset",
    """SELECT author, project FROM {v_commits} EXCEPT ALL SELECT author, project FROM {v_commits} WHERE label = 1""",
)
def q_except_subset(t):
    rows = t.v_commits
    return d.except_subset(
        rows.select("author", "project"), rows.filter("label = 1").select("author", "project")
    )


@query("q_rebuild_full", "SELECT commit_id, label, split FROM {o_split}")
def q_rebuild_full(t):
    rows = d.three_way_split(_labelled(t), 0.1, 0.2, seed=11).select("commit_id", "label", "split")
    parts = [rows.filter(F.col("split") == s) for s in ("train", "validation", "test")]
    return d.rebuild_full(parts)


@query(
    "q_mix_projects",
    """SELECT commit_id, commit_date, 1 AS label, lower(substr(project, 3)) AS project FROM {v_vulnerable} WHERE project IS NOT NULL""",
)
def q_mix_projects(t):
    rows = t.v_vulnerable.withColumn("label", F.lit(1))
    return d.mix_projects({p[2:].lower(): df for p, df in _by_project(rows).items()})


def _by_project(rows):
    """One frame per project; the projects are a dimension, read from the data."""
    names = [r[0] for r in rows.select("project").distinct().orderBy("project").collect() if r[0] is not None]
    return {p: rows.filter(F.col("project") == p).drop("project") for p in names}


@query("q_mix_sizes", "SELECT s.id, s.lines, m.project FROM {v_sizes} s JOIN {v_messages} m ON m.id = s.id WHERE m.project IS NOT NULL")
def q_mix_sizes(t):
    """Sizes of all projects, as the labels are mixed."""
    rows = t.v_sizes.join(t.v_messages.select("id", "project"), "id")
    return d.mix_projects(_by_project(rows))


VIEWS["v_project_slices"] = """
SELECT doc_id AS id, source AS project, CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, CAST(floor(length(text) / 2) AS INT)) END AS pre,
       CASE WHEN doc_id % 7 <> 0 THEN substr(text, CAST(floor(length(text) / 2) AS INT) + 1) END AS post FROM {documents}"""


@query("q_mix_slices", "SELECT id, pre, post, project FROM {v_project_slices} WHERE project IS NOT NULL AND (pre IS NOT NULL OR post IS NOT NULL)")
def q_mix_slices(t):
    """Changed code of all projects; rows without either side are no slices."""
    return d.mix_projects(_by_project(t.v_project_slices)).filter("pre IS NOT NULL OR post IS NOT NULL")


@query(
    "q_leave_one_out",
    """SELECT p.project AS held_out, c.commit_id, c.project, c.label FROM {v_commits} c
    JOIN (SELECT DISTINCT project FROM {v_commits}) p ON p.project <> c.project""",
)
def q_leave_one_out(t):
    return d.leave_one_project_out(t.v_commits.select("commit_id", "project", "label"))


@query(
    "q_set_overlap",
    """SELECT (SELECT count(*) FROM (SELECT commit_id FROM {v_safe} INTERSECT SELECT commit_id FROM {v_vulnerable})) AS both,
    (SELECT count(*) FROM (SELECT commit_id FROM {v_safe} EXCEPT SELECT commit_id FROM {v_vulnerable})) AS only_left,
    (SELECT count(*) FROM (SELECT commit_id FROM {v_vulnerable} EXCEPT SELECT commit_id FROM {v_safe})) AS only_right""",
)
def q_set_overlap(t):
    return d.set_overlap(t.v_safe, t.v_vulnerable, "commit_id")


VIEWS["v_change_counts"] = """
SELECT l_orderkey AS id, count(*) AS changes, sum(CAST(l_quantity AS BIGINT)) * 40 AS words,
       max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS label,
       max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS extracted
FROM {lineitem} GROUP BY l_orderkey"""


def _rules():
    none = F.col("extracted") == 0
    return {
        "too_many_changes": F.col("changes") > 8,
        "no_changes": none & (F.col("label") == 0),
        "positive_without_data": none & (F.col("label") == 1),
        "too_many_words": F.col("words") > 5000,
    }


@query(
    "q_outlier_filter",
    """SELECT id, changes, CAST(words AS BIGINT) AS words, label FROM {v_change_counts}
    WHERE NOT (changes > 8) AND NOT (extracted = 0) AND NOT (words > 5000)""",
)
def q_outlier_filter(t):
    rows = t.v_change_counts
    for rule in _rules().values():
        rows = rows.filter(~rule)
    return rows.select("id", "changes", "words", "label")


@query(
    "q_filter_audit",
    """SELECT count(*) AS n, count(*) FILTER (changes > 8) AS too_many_changes,
    count(*) FILTER (extracted = 0 AND label = 0) AS no_changes,
    count(*) FILTER (extracted = 0 AND label = 1) AS positive_without_data,
    count(*) FILTER (words > 5000) AS too_many_words,
    count(*) FILTER (NOT (changes > 8) AND extracted = 1 AND NOT (words > 5000)) AS kept,
    round(count(*) FILTER (NOT (changes > 8) AND extracted = 1 AND NOT (words > 5000)) / count(*), 6) AS kept_share
    FROM {v_change_counts}""",
)
def q_filter_audit(t):
    a = d.filter_audit(t.v_change_counts, _rules())
    return a.withColumn("kept_share", F.round("kept_share", 6))


@query("q_feature_subset", "SELECT l_orderkey, l_partkey, l_quantity, l_tax FROM lineitem")
def q_feature_subset(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return d.feature_subset(rows, drop=["l_discount"], ids=["l_orderkey", "l_partkey"])


@query(
    "q_mean_impute",
    """SELECT commit_id, path, CAST(big AS DOUBLE) AS big, round(coalesce(lines, avg(lines) OVER ()), 6) AS lines FROM (
      SELECT commit_id, path, CASE WHEN lines_before > 500 THEN 1 ELSE 0 END AS big,
             CASE WHEN lines_deleted = 0 THEN NULL ELSE lines_deleted END AS lines FROM {v_file_changes})""",
)
def q_mean_impute(t):
    rows = t.v_file_changes.select(
        "commit_id", "path", (F.col("lines_before") > 500).alias("big"),
        F.when(F.col("lines_deleted") != 0, F.col("lines_deleted")).alias("lines"),
    )
    return d.impute_mean(rows, ["big", "lines"]).select("commit_id", "path", "big", r6("lines", "lines"))


@query(
    "q_kfold",
    """SELECT commit_id, CASE WHEN f < 5 THEN CAST(f AS INT) END AS fold FROM (
      SELECT commit_id, floor((row_number() OVER (ORDER BY commit_date, commit_id) - 1) / floor(count(*) OVER () / 5)) AS f
      FROM {v_commits})""",
)
def q_kfold(t):
    return d.position_folds(t.v_commits.select("commit_id", "commit_date"), ["commit_date", "commit_id"]).drop(
        "commit_date"
    )


@query(
    "q_recent_n",
    """SELECT commit_id, project, CASE WHEN rn <= 200 THEN 'test' ELSE 'train' END AS part FROM (
      SELECT commit_id, project, row_number() OVER (PARTITION BY project ORDER BY commit_date DESC, commit_id DESC) AS rn
      FROM {v_commits}) WHERE rn <= 1000""",
)
def q_recent_n(t):
    rows = t.v_commits.select("commit_id", "project", "commit_date")
    order = [falling("commit_date"), falling("commit_id")]
    return d.recent_windows(rows, ["project"], order, train=800, test=200).drop("commit_date")
