"""Lifetimes on the supplied tables."""

from pyspark.sql import functions as F

from faultline.functions.columns import big, r6
from faultline.operators import lifetimes as lt
from faultline.operators import provenance as p
from faultline.operators.user_aggregate import median_of_means, user_aggregate
from faultline.plans.provenance import _hunks, _versions
from faultline.plans.registry import VIEWS, query
from faultline.session import stored

VIEWS["o_blame_n"] = "SELECT fix, blame_commit, count(*) AS weight FROM {o_cand_named} GROUP BY 1, 2"

VIEWS["o_summary"] = """
SELECT fix, arg_min(blame_commit, (-weight, blame_commit)) AS most_blamed, arg_min(day, (-weight, blame_commit)) AS most_blamed_date,
       arg_min(blame_commit, (day, blame_commit)) AS oldest, min(day) AS oldest_date,
       arg_min(blame_commit, (-date_diff('day', DATE '1900-01-01', day), blame_commit)) AS newest, max(day) AS newest_date,
       CAST(DATE '1900-01-01' + CAST(floor(avg(d)) AS INT) AS DATE) AS average_date,
       CAST(DATE '1900-01-01' + CAST(floor(sum(d * weight) / sum(weight)) AS INT) AS DATE) AS weighted_date
FROM (SELECT n.*, CAST(c.commit_date AS DATE) AS day, date_diff('day', DATE '1900-01-01', CAST(c.commit_date AS DATE)) AS d
      FROM {o_blame_n} n JOIN {v_commits} c ON c.commit_id = n.blame_commit) GROUP BY fix"""


def _summary(t):
    _, blame = _versions(t)
    counts = p.run_heuristic("all_lines", _hunks(t), blame)
    return lt.blame_summary(counts, t.v_commits)


@query("q_blame_summary", "SELECT * FROM {o_summary}")
def q_blame_summary(t):
    return _summary(t)


@query(
    "q_lifetimes",
    """SELECT o.o_custkey AS cve, s.*, CAST(o.o_orderdate AS DATE) AS fix_date,
    CASE WHEN pm.project = po.project THEN po.place - pm.place END AS most_blamed_commits,
    CASE WHEN pl.project = po.project THEN po.place - pl.place END AS oldest_commits,
    CASE WHEN pn.project = po.project THEN po.place - pn.place END AS newest_commits,
    c.c_mktsegment AS cwe, c.c_acctbal AS score, coalesce(a.stable, 'no') AS stable
    FROM {o_summary} s JOIN orders o ON o.o_orderkey = s.fix JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN {o_places} po ON po.commit_id = s.fix JOIN {o_places} pm ON pm.commit_id = s.most_blamed
    JOIN {o_places} pl ON pl.commit_id = s.oldest JOIN {o_places} pn ON pn.commit_id = s.newest
    LEFT JOIN (SELECT cve, arg_max(v, page_id) AS stable FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(url, '[0-9]+')) AS cve,
      CASE WHEN starts_with(url, 'https') THEN 'yes' ELSE 'no' END AS v FROM pages) GROUP BY 1) a ON a.cve = CAST(o.o_custkey AS VARCHAR)""",
)
def q_lifetimes(t):
    summary = stored(_summary(t), "blame_summary")
    links = t.orders.select(F.col("o_custkey").alias("cve"), F.col("o_orderkey").alias("fix"))
    pairs = None
    for which in ("most_blamed", "oldest", "newest"):
        one = summary.select(F.col(which).alias("older"), F.col("fix").alias("newer"))
        pairs = one if pairs is None else pairs.unionByName(one)
    distances = p.commit_distance(pairs.distinct(), t.v_commits)
    info = t.customer.select(F.col("c_custkey").alias("cve"), F.col("c_mktsegment").alias("cwe"), F.col("c_acctbal").alias("score"))
    adv = t.pages.select(
        F.col("url").alias("text"), F.col("page_id").alias("advisory_id"),
        F.when(F.startswith("url", F.lit("https")), "yes").otherwise("no").alias("is_vulnerable"),
    )
    cves = t.customer.select(F.col("c_custkey").cast("string").alias("cve"))
    stable = p.advisory_flags(cves, adv, "[0-9]+").withColumn("cve", F.col("cve").cast("bigint"))
    return lt.lifetime_records(links, summary, t.v_commits, distances, info, stable)


# --- CVE level -----------------------------------------------------------------------------------
VIEWS["o_cve"] = """
SELECT *, CAST(year(latest_fix) AS INT) AS fix_year, CAST(date_diff('day', h_oldest, latest_fix) AS INT) AS h_lifetime,
  CAST(CASE WHEN date_diff('day', t_oldest, latest_fix) > 0 THEN date_diff('day', t_oldest, latest_fix) ELSE date_diff('day', h_oldest, latest_fix) END AS INT) AS lifetime,
  CAST(CASE WHEN t_oldest IS NOT NULL THEN greatest(date_diff('day', t_oldest, latest_fix), 0) END AS INT) AS c_lifetime,
  CAST(date_diff('day', lower_vcc, latest_fix) AS INT) AS lifetime_lower
FROM (SELECT project, cve, max(fix_date) AS latest_fix, min(est_date) AS h_oldest, min(true_date) AS t_oldest, min(newest_date) AS lower_vcc,
        arg_min(category, (fix, nr)) AS category, arg_min(score, (fix, nr)) AS score, arg_min(stable, (fix, nr)) AS stable,
        bool_and(confident) AS confident, count(*) AS n_fixes
      FROM {o_life_unique} GROUP BY 1, 2)"""

# (fix, nr) may repeat for a CVE; one record each keeps "first" well defined
VIEWS["o_life_unique"] = """
SELECT project, cve, fix, nr, category, min(fix_date) AS fix_date, min(est_date) AS est_date, min(oldest_date) AS oldest_date, min(newest_date) AS newest_date,
       min(true_date) AS true_date, min(score) AS score, min(stable) AS stable, bool_and(confident) AS confident
FROM {v_lifetimes} GROUP BY project, cve, fix, nr, category"""


ROWS_PER_TASK = 500_000


def _spread_lifetimes(t):
    """``v_lifetimes`` from tables dealt over as many tasks as their rows need, first by commit and then by CVE: what a task
    sorts and joins stays the same as the tables grow, and the records of a CVE need not move again. The number is given even
    where it is below the session's: adaptive execution would merge those partitions by their packed size, to millions of rows."""
    n = -(-t.lineitem.count() // ROWS_PER_TASK)
    if n <= 1:
        return t.v_lifetimes
    by = {"lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey"}
    rows = t.spark.sql(VIEWS["v_lifetimes"], **{name: getattr(t, name).repartition(n, key) for name, key in by.items()})
    return rows.repartition(n, "cve")


def _records(t):
    keys = ["project", "cve", "fix", "nr", "category"]
    dates = ["fix_date", "est_date", "oldest_date", "newest_date", "true_date", "score", "stable"]
    return _spread_lifetimes(t).groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in dates], F.bool_and("confident").alias("confident")
    )


def _cves(t):
    return lt.cve_lifetimes(_records(t))


@query(
    "q_cve_lifetime",
    """SELECT project, cve, latest_fix, h_oldest, t_oldest, category, round(score, 6) AS score, stable, confident, n_fixes, fix_year, h_lifetime, lifetime,
    c_lifetime, lifetime_lower FROM {o_cve}""",
)
def q_cve_lifetime(t):
    return _cves(t).withColumn("score", F.round("score", 6))


@query(
    "q_lifetime_table",
    """WITH g AS (SELECT category, avg(lifetime) AS average, median(lifetime) AS median, stddev_pop(lifetime) AS deviation, var_samp(lifetime) AS variance FROM {o_cve} GROUP BY 1)
    SELECT category, round(average, 6) AS average, round(median, 6) AS median, round(deviation, 6) AS deviation, round(variance, 4) AS variance FROM (
      SELECT * FROM g UNION ALL SELECT 'Macro Avg.', avg(average), avg(median), avg(deviation), avg(variance) FROM g
      UNION ALL SELECT 'Overall', avg(lifetime), median(lifetime), stddev_pop(lifetime), var_samp(lifetime) FROM {o_cve})""",
)
def q_lifetime_table(t):
    out = lt.lifetime_table(_cves(t), "category")
    return out.select(
        "category", r6("average", "average"), r6("median", "median"), r6("deviation", "deviation"), F.round("variance", 4).alias("variance")
    )


@query(
    "q_lifetime_quantiles",
    """SELECT round(m, 6) AS mean, round(avg(abs(lifetime - m)), 6) AS mean_deviation, round(100.0 * count(*) FILTER (lifetime <= m) / count(*), 6) AS pct_up_to_mean,
    round(quantile_cont(lifetime, 0.25), 6) AS q1, round(quantile_cont(lifetime, 0.5), 6) AS median, round(quantile_cont(lifetime, 0.75), 6) AS q3
    FROM {o_cve}, (SELECT avg(lifetime) AS m FROM {o_cve}) GROUP BY m""",
)
def q_lifetime_quantiles(t):
    out = lt.lifetime_quantiles(_cves(t))
    return out.select(*[r6(c, c) for c in out.columns])


@query(
    "q_year_trend",
    """SELECT fix_year, count(*) AS n, round(avg(lifetime), 6) AS value FROM {o_cve} GROUP BY 1 HAVING count(*) >= 20""",
)
def q_year_trend(t):
    return lt.yearly(_cves(t), "fix_year", "lifetime", 20).select("fix_year", "n", r6("value", "value"))


@query(
    "q_year_trend_median",
    """SELECT fix_year, count(*) AS n, round(median(lifetime), 6) AS value FROM {o_cve} GROUP BY 1 HAVING count(*) >= 45""",
)
def q_year_trend_median(t):
    return lt.yearly(_cves(t), "fix_year", "lifetime", 45, "median").select("fix_year", "n", r6("value", "value"))


@query(
    "q_year_mix",
    """SELECT fix_year, round(avg(coalesce(c_lifetime, h_lifetime)), 6) AS mean_combined, count(c_lifetime) AS n_true, count(*) - count(c_lifetime) AS n_estimated,
    round(100.0 * count(c_lifetime) / count(*), 6) AS pct_true FROM {o_cve} GROUP BY 1""",
)
def q_year_mix(t):
    out = lt.year_mix(_cves(t))
    return out.select("fix_year", r6("mean_combined", "mean_combined"), "n_true", "n_estimated", r6("pct_true", "pct_true"))


@query(
    "q_box_stats",
    """WITH q AS (SELECT fix_year, quantile_cont(lifetime, 0.25) AS q1, median(lifetime) AS median, quantile_cont(lifetime, 0.75) AS q3 FROM {o_cve} GROUP BY 1)
    SELECT q.fix_year, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    CAST(min(lifetime) FILTER (lifetime BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_low,
    CAST(max(lifetime) FILTER (lifetime BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_high,
    count(*) FILTER (NOT lifetime BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outside
    FROM {o_cve} c JOIN q ON q.fix_year = c.fix_year GROUP BY 1, 2, 3, 4""",
)
def q_box_stats(t):
    out = lt.box_stats(_cves(t), "fix_year", "lifetime")
    return out.select("fix_year", r6("q1", "q1"), r6("median", "median"), r6("q3", "q3"), "whisker_low", "whisker_high", "n_outside")


_REFS = ["1995-01-01", "1997-01-01", "1999-01-01", "2001-01-01"]


@query(
    "q_code_age",
    f"""WITH d AS (SELECT c.project, CAST(c.commit_date AS DATE) AS day, sum(f.lines_added) AS n FROM {{v_file_changes}} f JOIN {{v_commits}} c ON c.commit_id = f.commit_id GROUP BY 1, 2)
    SELECT d.project, r.reference, round(sum(date_diff('day', d.day, r.reference) * n) / sum(n), 6) AS age
    FROM d JOIN (SELECT CAST(unnest({_REFS}) AS DATE) AS reference) r ON d.day <= r.reference GROUP BY 1, 2""",
)
def q_code_age(t):
    projects = t.v_commits.select("commit_id", "project")
    lines = t.v_file_changes.join(projects, "commit_id").select(
        "project", F.to_date("commit_date").alias("day"), F.col("lines_added").alias("n_lines")
    )
    return lt.code_age(lines, _REFS).select("project", "reference", r6("age", "age"))


VIEWS["v_cwes"] = "SELECT p_partkey AS cve, concat('CWE-', CAST(p_size * 5 + 14 AS VARCHAR(10))) AS cwe FROM {part}"

# Weakness class, number and name of its category, by category.
_CATEGORY_ROWS = """
('119', 1, 'Memory and Resource Management'),
('120', 1, 'Memory and Resource Management'),
('125', 1, 'Memory and Resource Management'),
('190', 1, 'Memory and Resource Management'),
('191', 1, 'Memory and Resource Management'),
('399', 1, 'Memory and Resource Management'),
('400', 1, 'Memory and Resource Management'),
('404', 1, 'Memory and Resource Management'),
('415', 1, 'Memory and Resource Management'),
('416', 1, 'Memory and Resource Management'),
('476', 1, 'Memory and Resource Management'),
('664', 1, 'Memory and Resource Management'),
('763', 1, 'Memory and Resource Management'),
('770', 1, 'Memory and Resource Management'),
('772', 1, 'Memory and Resource Management'),
('787', 1, 'Memory and Resource Management'),
('824', 1, 'Memory and Resource Management'),
('1187', 1, 'Memory and Resource Management'),
('20', 2, 'Input Validation and Sanitization'),
('22', 2, 'Input Validation and Sanitization'),
('59', 2, 'Input Validation and Sanitization'),
('74', 2, 'Input Validation and Sanitization'),
('77', 2, 'Input Validation and Sanitization'),
('78', 2, 'Input Validation and Sanitization'),
('89', 2, 'Input Validation and Sanitization'),
('91', 2, 'Input Validation and Sanitization'),
('93', 2, 'Input Validation and Sanitization'),
('94', 2, 'Input Validation and Sanitization'),
('129', 2, 'Input Validation and Sanitization'),
('502', 2, 'Input Validation and Sanitization'),
('707', 2, 'Input Validation and Sanitization'),
('17', 3, 'Code Development Quality'),
('193', 3, 'Code Development Quality'),
('369', 3, 'Code Development Quality'),
('617', 3, 'Code Development Quality'),
('674', 3, 'Code Development Quality'),
('682', 3, 'Code Development Quality'),
('834', 3, 'Code Development Quality'),
('835', 3, 'Code Development Quality'),
('79', 4, 'Security Measures'),
('92', 4, 'Security Measures'),
('189', 4, 'Security Measures'),
('200', 4, 'Security Measures'),
('203', 4, 'Security Measures'),
('254', 4, 'Security Measures'),
('255', 4, 'Security Measures'),
('264', 4, 'Security Measures'),
('269', 4, 'Security Measures'),
('275', 4, 'Security Measures'),
('276', 4, 'Security Measures'),
('281', 4, 'Security Measures'),
('284', 4, 'Security Measures'),
('285', 4, 'Security Measures'),
('287', 4, 'Security Measures'),
('290', 4, 'Security Measures'),
('310', 4, 'Security Measures'),
('311', 4, 'Security Measures'),
('319', 4, 'Security Measures'),
('320', 4, 'Security Measures'),
('327', 4, 'Security Measures'),
('347', 4, 'Security Measures'),
('358', 4, 'Security Measures'),
('426', 4, 'Security Measures'),
('522', 4, 'Security Measures'),
('538', 4, 'Security Measures'),
('601', 4, 'Security Measures'),
('668', 4, 'Security Measures'),
('732', 4, 'Security Measures'),
('862', 4, 'Security Measures'),
('863', 4, 'Security Measures'),
('922', 4, 'Security Measures'),
('NVD-Other', 5, 'Others'),
('16', 5, 'Others'),
('19', 5, 'Others'),
('134', 5, 'Others'),
('199', 5, 'Others'),
('252', 5, 'Others'),
('295', 5, 'Others'),
('330', 5, 'Others'),
('345', 5, 'Others'),
('346', 5, 'Others'),
('352', 5, 'Others'),
('354', 5, 'Others'),
('388', 5, 'Others'),
('391', 5, 'Others'),
('417', 5, 'Others'),
('427', 5, 'Others'),
('434', 5, 'Others'),
('532', 5, 'Others'),
('534', 5, 'Others'),
('610', 5, 'Others'),
('665', 5, 'Others'),
('704', 5, 'Others'),
('706', 5, 'Others'),
('754', 5, 'Others'),
('755', 5, 'Others'),
('829', 5, 'Others'),
('843', 5, 'Others'),
('918', 5, 'Others'),
('1021', 5, 'Others'),
('361', 6, 'Concurrency'),
('362', 6, 'Concurrency')"""


@query(
    "q_category_map",
    f"""SELECT v.cve, v.cwe, m.cat, m.cat_name FROM {{v_cwes}} v LEFT JOIN (VALUES {_CATEGORY_ROWS}) m(cwe_id, cat, cat_name) ON 'CWE-' || m.cwe_id = v.cwe""",
)
def q_category_map(t):
    return lt.with_category(t.v_cwes, "cwe").select("cve", "cwe", "cat", "cat_name")


VIEWS["v_tree"] = """
SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS node, concat('n', CAST(s_nationkey AS VARCHAR(20))) AS parent FROM {supplier}
UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR(20))), concat('r', CAST(n_regionkey AS VARCHAR(20))) FROM {nation}"""


@query(
    "q_root_category",
    """WITH RECURSIVE w AS (SELECT node, parent AS root, 1 AS depth FROM {v_tree} UNION ALL SELECT w.node, t.parent, w.depth + 1 FROM w JOIN {v_tree} t ON t.node = w.root)
    SELECT node, arg_max(root, depth) AS root FROM w GROUP BY 1""",
)
def q_root_category(t):
    return lt.roots(t.v_tree)


@query(
    "q_score_bucket",
    """SELECT cve, fix, nr, round_even(score, 0) AS bucket FROM (SELECT cve, fix, nr, CAST(score AS DOUBLE) AS score FROM {v_lifetimes})""",
)
def q_score_bucket(t):
    return t.v_lifetimes.select("cve", "fix", "nr", lt.score_bucket(F.col("score")).alias("bucket"))


VIEWS["v_texts"] = """
SELECT l_partkey AS cve, l_orderkey AS fix, CASE WHEN l_returnflag = 'R' THEN 'yes (stable)' ELSE 'no' END AS stable,
       CASE WHEN l_tax = 0 THEN '' WHEN l_tax > 0.07 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END AS commits FROM {lineitem}"""


@query(
    "q_stable_only",
    """SELECT cve, fix, stable, coalesce(try_cast(nullif(commits, '') AS INT), 0) AS commits FROM {v_texts} WHERE contains(stable, 'yes')""",
)
def q_stable_only(t):
    return lt.stable_only(t.v_texts, ["commits"])


@query(
    "q_top_categories",
    """SELECT category, count(*) AS n, round(avg(lifetime), 6) AS mean_lifetime FROM {o_cve} GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 6""",
)
def q_top_categories(t):
    return lt.top_categories(_cves(t), "category", 6).select("category", "n", r6("mean_lifetime", "mean_lifetime"))


@query(
    "q_moving_avg",
    """WITH b AS (SELECT CAST(lifetime // 100 AS BIGINT) AS bin, count(*) AS n FROM {o_cve} GROUP BY 1),
    f AS (SELECT i AS bin, coalesce(n, 0) AS n FROM range((SELECT max(bin) + 1 FROM b)) r(i) LEFT JOIN b ON b.bin = r.i)
    SELECT CAST(bin AS BIGINT) AS bin, round(m, 6) AS moving FROM (SELECT bin, avg(n) OVER (ORDER BY bin ROWS 2 PRECEDING) AS m, row_number() OVER (ORDER BY bin) AS rn FROM f) WHERE rn >= 3""",
)
def q_moving_avg(t):
    bins = _cves(t).groupBy(F.floor(F.col("lifetime") / 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # bins without rows count zero
    top = bins.agg(F.max("bin").alias("top"))
    every = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("bin"))
    full = every.join(bins, "bin", "left").na.fill(0, ["n"])
    return lt.moving_average(full, "bin", "n", 3).select("bin", r6("moving", "moving"))


@query(
    "q_match_rate",
    """SELECT count(*) AS n, round(avg(CASE WHEN est_date = true_date THEN 1.0 ELSE 0 END), 6) AS exact,
    round(avg(CASE WHEN oldest_date <= true_date THEN 1.0 ELSE 0 END), 6) AS upper_holds, round(avg(CASE WHEN newest_date >= true_date THEN 1.0 ELSE 0 END), 6) AS lower_holds
    FROM {v_lifetimes} WHERE true_date IS NOT NULL""",
)
def q_match_rate(t):
    out = lt.match_rates(t.v_lifetimes)
    return out.select("n", r6("exact", "exact"), r6("upper_holds", "upper_holds"), r6("lower_holds", "lower_holds"))


@query(
    "q_error_dist",
    """SELECT project, round(avg(e), 6) AS mean_error, round(stddev_pop(e), 6) AS deviation, round(avg(abs(e)), 6) AS mae,
    round(avg(100.0 * e / nullif(life, 0)), 6) AS mean_error_pct, count(*) AS n FROM (
      SELECT project, date_diff('day', est_date, true_date) AS e, date_diff('day', true_date, fix_date) AS life FROM {v_lifetimes} WHERE true_date IS NOT NULL) GROUP BY 1""",
)
def q_error_dist(t):
    days = lt.error_distribution(t.v_lifetimes, ["project"], "est_date")
    pct = lt.error_distribution(t.v_lifetimes, ["project"], "est_date", relative=True)
    both = days.join(pct.select("project", F.col("mean_error").alias("mean_error_pct")), "project")
    return both.select(
        "project", r6("mean_error", "mean_error"), r6("deviation", "deviation"), r6("mae", "mae"), r6("mean_error_pct", "mean_error_pct"), "n"
    )


@query(
    "q_patch_rows",
    """SELECT o_orderkey, CASE o_orderkey WHEN 10 THEN 'patched' WHEN 12 THEN 'patched too' ELSE o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderkey NOT IN (0, 3)""",
)
def q_patch_rows(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return lt.patched(rows, "o_orderkey", [0, 3], {10: "patched", 12: "patched too"}, "o_orderpriority").select(
        "o_orderkey", "o_orderpriority"
    )


@query(
    "q_user_aggregate",
    """SELECT category, project, round(median(m), 6) AS value FROM (
      SELECT category, project, avg(date_diff('day', est_date, fix_date)) AS m FROM {v_lifetimes} GROUP BY category, project, fix % 8) GROUP BY ALL""",
)
def q_user_aggregate(t):
    """A robust mean of the lifetimes of each category and project, written as a user's aggregate."""
    rows = t.v_lifetimes.withColumn("days", F.date_diff("fix_date", "est_date"))
    out = user_aggregate(rows, ["category", "project"], ["days", "fix"], median_of_means(8))
    return out.select("category", "project", r6("value", "value"))
