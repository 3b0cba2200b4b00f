"""Trends, fits and tests on the supplied tables."""

from pyspark.sql import functions as F

from faultline.functions.columns import big, r6
from faultline.operators import lifetimes as lt
from faultline.operators import statistics as st
from faultline.plans.lifetimes import _cves
from faultline.plans.registry import VIEWS, query

VIEWS["o_yearly"] = """
SELECT fix_year, count(*) AS n, avg(lifetime) AS value FROM {o_cve} GROUP BY 1 HAVING count(*) >= 20"""


@query(
    "q_linear_trend",
    """SELECT round(regr_slope(value, fix_year), 6) AS slope, round(regr_intercept(value, fix_year), 4) AS intercept, round(regr_r2(value, fix_year), 6) AS r2, count(*) AS n FROM {o_yearly}""",
)
def q_linear_trend(t):
    out = st.linear_trend(lt.yearly(_cves(t), "fix_year", "lifetime", 20), "fix_year", "value")
    return out.select(r6("slope", "slope"), F.round("intercept", 4).alias("intercept"), r6("r2", "r2"), "n")


@query(
    "q_trend_of_aggregate",
    """SELECT round(regr_slope(value, fix_year), 6) AS slope, count(*) AS n FROM (
      SELECT fix_year, stddev_samp(lifetime) AS value FROM {o_cve} GROUP BY 1 HAVING count(*) >= 20)""",
)
def q_trend_of_aggregate(t):
    """The trend of any aggregate expression, here the deviation."""
    rows = lt.yearly(_cves(t), "fix_year", "lifetime", 20, F.stddev_samp("lifetime"))
    return st.linear_trend(rows, "fix_year", "value").select(r6("slope", "slope"), "n")


@query(
    "q_range_trend",
    """SELECT range, round(regr_slope(value, fix_year), 6) AS slope, count(*) AS n FROM (
      SELECT '1995-1998' AS range, * FROM {o_yearly} WHERE fix_year BETWEEN 1995 AND 1998 UNION ALL
      SELECT '1997-2001', * FROM {o_yearly} WHERE fix_year BETWEEN 1997 AND 2001) GROUP BY 1""",
)
def q_range_trend(t):
    points = lt.yearly(_cves(t), "fix_year", "lifetime", 20)
    out = st.range_trends(points, "fix_year", "value", [(1995, 1998), (1997, 2001)])
    return out.select("range", r6("slope", "slope"), "n")


@query(
    "q_adaptive_bins",
    """WITH y AS (SELECT fix_year AS y, count(*) AS n FROM {o_cve} GROUP BY 1),
    s AS (SELECT min(y) AS lo, max(y) - min(y) AS w, count(*) AS k FROM y),
    c AS (SELECT bins, lo, w, greatest(CAST(ceil((y - lo) * bins / w) AS BIGINT), 1) AS bin, sum(n) AS n FROM y, s, range(2, (SELECT k + 1 FROM s)) r(bins) GROUP BY 1, 2, 3, 4),
    b AS (SELECT max(bins) AS bins FROM (SELECT bins FROM c GROUP BY 1 HAVING min(n) >= 20 AND count(*) = bins))
    SELECT bin, CAST(CASE WHEN bin = 1 THEN lo ELSE floor(lo + (bin - 1) * w / bins) + 1 END AS BIGINT) AS year_from, CAST(floor(lo + bin * w / bins) AS BIGINT) AS year_to, CAST(n AS BIGINT) AS n
    FROM c WHERE bins = (SELECT bins FROM b)""",
)
def q_adaptive_bins(t):
    return st.adaptive_bins(_cves(t), "fix_year", 20)


@query(
    "q_year_buckets",
    """WITH y AS (SELECT fix_year, count(*) AS n, sum(lifetime) AS a, sum(lifetime_lower) AS b, row_number() OVER (ORDER BY fix_year) - 1 AS r FROM {o_cve} GROUP BY 1),
    s AS (SELECT floor((max(fix_year) - min(fix_year)) / 3) AS size FROM y)
    SELECT CAST(CASE WHEN r < size THEN 0 ELSE floor((r - size) / (size + 1)) + 1 END AS INT) AS bucket, min(fix_year) AS year_from, max(fix_year) AS year_to, CAST(sum(n) AS BIGINT) AS n,
    round(sum(a) / sum(n), 6) AS lifetime, round(sum(b) / sum(n), 6) AS lifetime_lower FROM y, s GROUP BY 1""",
)
def q_year_buckets(t):
    out = st.year_buckets(_cves(t), "fix_year", ["lifetime", "lifetime_lower"], 3)
    return out.select("bucket", "year_from", "year_to", "n", r6("lifetime", "lifetime"), r6("lifetime_lower", "lifetime_lower"))


@query(
    "q_spearman",
    """SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY lifetime) + (count(*) OVER (PARTITION BY lifetime) - 1) / 2 AS a,
    rank() OVER (ORDER BY fix_year) + (count(*) OVER (PARTITION BY fix_year) - 1) / 2 AS b FROM {o_cve})""",
)
def q_spearman(t):
    return st.spearman(_cves(t), "lifetime", "fix_year").select("n", r6("rho", "rho"))


@query(
    "q_kruskal",
    """WITH r AS (SELECT category, lifetime, rank() OVER (ORDER BY lifetime) + (count(*) OVER (PARTITION BY lifetime) - 1) / 2 AS rk FROM {o_cve}),
    g AS (SELECT category, sum(rk) AS s, CAST(count(*) AS DOUBLE) AS m FROM r GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r),
    t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY lifetime))
    SELECT round((12 / (n * (n + 1)) * sum(s * s / m) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, count(*) - 1 AS df FROM g, n, t GROUP BY n, ties""",
)
def q_kruskal(t):
    return st.kruskal(_cves(t), "category", "lifetime").select(r6("h", "h"), "df")


@query(
    "q_kruskal_p",
    """WITH r AS (SELECT category, lifetime, rank() OVER (ORDER BY lifetime) + (count(*) OVER (PARTITION BY lifetime) - 1) / 2 AS rk FROM {o_cve}),
    g AS (SELECT category, sum(rk) AS s, CAST(count(*) AS DOUBLE) AS m FROM r GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r),
    t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY lifetime)),
    k AS (SELECT (12 / (n * (n + 1)) * sum(s * s / m) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, (count(*) - 1) // 2 AS half FROM g, n, t GROUP BY n, ties),
    e AS (SELECT any_value(h) AS h, sum(pow(h / 2, i) / CAST(factorial(CAST(i AS INT)) AS DOUBLE)) AS terms FROM (SELECT h, unnest(range(0, half)) AS i FROM k))
    SELECT round(h, 6) AS h, round(exp(-h / 2) * terms, 6) AS p_value FROM e""",
)
def q_kruskal_p(t):
    """All categories; with an even number of degrees of freedom the tail has a closed form for the oracle."""
    return st.kruskal(_cves(t), "category", "lifetime").select(r6("h", "h"), r6("p_value", "p_value"))


ROUNDS = 100_000


@query("q_permutation")
def q_permutation(t):
    """Every pair of weakness categories at the full number of rounds."""
    return st.pairwise_permutation(_cves(t), "category", "lifetime", rounds=ROUNDS, seed=0)


@query(
    "q_permutation_difference",
    """WITH g AS (SELECT category, avg(CAST(lifetime AS DOUBLE)) AS m FROM {o_cve} GROUP BY 1)
    SELECT a.category AS a, b.category AS b, round(a.m - b.m, 6) AS difference, CAST(100000 AS BIGINT) AS rounds, true AS possible
    FROM g a JOIN g b ON a.category < b.category""",
)
def q_permutation_difference(t):
    """What of the test does not depend on the draws, over the same pairs and rounds."""
    out = st.pairwise_permutation(_cves(t), "category", "lifetime", rounds=ROUNDS, seed=0)
    return out.select("a", "b", r6("difference", "difference"), "rounds", F.col("p_value").between(1 / (ROUNDS + 1), 1).alias("possible"))


@query(
    "q_expon_ks",
    """WITH f AS (SELECT min(lifetime) AS loc, avg(lifetime) - min(lifetime) AS scale, count(*) AS n FROM {o_cve}),
    c AS (SELECT 1 - exp(-(lifetime - loc) / scale) AS cdf, row_number() OVER (ORDER BY lifetime) AS i, n, loc, scale FROM {o_cve}, f)
    SELECT CAST(loc AS DOUBLE) AS loc, round(scale, 6) AS scale, n, round(max(greatest(i / n - cdf, cdf - (i - 1) / n)), 6) AS ks FROM c GROUP BY 1, 2, 3""",
)
def q_expon_ks(t):
    return st.exponential_fit(_cves(t), "lifetime").select("loc", r6("scale", "scale"), "n", r6("ks", "ks"))


@query(
    "q_expon_by_period",
    """WITH d AS (SELECT lifetime, CASE WHEN fix_year <= 1996 THEN 1996 WHEN fix_year <= 1999 THEN 1999 WHEN fix_year <= 2005 THEN 2005 END AS period FROM {o_cve}),
    f AS (SELECT period, min(lifetime) AS loc, avg(lifetime) - min(lifetime) AS scale, count(*) AS n FROM d GROUP BY 1),
    c AS (SELECT d.period, 1 - exp(-(lifetime - loc) / scale) AS cdf, row_number() OVER (PARTITION BY d.period ORDER BY lifetime) AS i, n, loc, scale FROM d JOIN f ON d.period = f.period)
    SELECT period, CAST(loc AS DOUBLE) AS loc, round(scale, 6) AS scale, n, round(max(greatest(i / n - cdf, cdf - (i - 1) / n)), 6) AS ks FROM c GROUP BY 1, 2, 3, 4""",
)
def q_expon_by_period(t):
    rows = _cves(t).withColumn("period", st.period_of("fix_year", [1996, 1999, 2005])).filter("period IS NOT NULL")
    return st.exponential_fit(rows, "lifetime", ["period"]).select("period", "loc", r6("scale", "scale"), "n", r6("ks", "ks"))


@query(
    "q_constant_factor",
    """WITH k AS (SELECT *, date_diff('day', oldest_date, true_date) AS gap, date_diff('day', oldest_date, fix_date) AS bl, date_diff('day', true_date, fix_date) AS life,
      date_diff('day', est_date, true_date) AS e FROM {v_lifetimes} WHERE true_date IS NOT NULL),
    p AS (SELECT avg(gap) AS c, sum(CASE WHEN bl <> 0 THEN gap / bl END) / count(*) AS p FROM k WHERE year(fix_date) < 1998)
    SELECT round(c, 6) AS constant_days, round(p, 6) AS constant_share, round(avg(e), 6) AS error_weighted, round(avg(gap - c), 6) AS error_constant,
    round(avg(life - (bl + p * bl)), 6) AS error_share, count(*) AS n FROM k, p WHERE year(fix_date) >= 1998 GROUP BY c, p""",
)
def q_constant_factor(t):
    out = st.constant_factor(t.v_lifetimes, 1998)
    return out.select(*[r6(c, c) for c in out.columns if c != "n"], "n")


@query(
    "q_bound_error",
    """SELECT CAST(year(fix_date) AS INT) AS year, count(*) AS n, round(avg(date_diff('day', est_date, true_date)) / avg(date_diff('day', true_date, fix_date)) * 100, 6) AS pct_estimate,
    round(avg(date_diff('day', newest_date, true_date)) / avg(date_diff('day', true_date, fix_date)) * 100, 6) AS pct_lower
    FROM {v_lifetimes} WHERE true_date IS NOT NULL GROUP BY 1 HAVING count(*) >= 20""",
)
def q_bound_error(t):
    out = st.bound_errors(t.v_lifetimes)
    return out.select("year", "n", r6("pct_estimate", "pct_estimate"), r6("pct_lower", "pct_lower"))


VIEWS["o_scored_life"] = """
SELECT bucket, count(*) AS n, avg(d) AS value FROM (SELECT round_even(CAST(score AS DOUBLE), 0) AS bucket, date_diff('day', est_date, fix_date) AS d FROM {v_lifetimes}) GROUP BY 1 HAVING count(*) > 20"""


@query(
    "q_score_lifetime",
    """SELECT s.bucket, s.n, round(s.value, 6) AS value, round(c.rho, 6) AS rho FROM {o_scored_life} s,
    (SELECT corr(a, b) AS rho FROM (SELECT rank() OVER (ORDER BY bucket) AS a, rank() OVER (ORDER BY value) AS b FROM {o_scored_life})) c""",
)
def q_score_lifetime(t):
    rows = t.v_lifetimes.select(lt.score_bucket(F.col("score")).alias("bucket"), F.date_diff("fix_date", "est_date").alias("d"))
    means = lt.yearly(rows, "bucket", "d", 21)
    rho = st.spearman(means, "bucket", "value").select("rho").scalar()
    return means.select("bucket", "n", r6("value", "value"), r6(rho, "rho"))


@query(
    "q_mean_ci",
    """SELECT category, round(avg(lifetime), 6) AS mean, round(avg(lifetime) - 1.96 * stddev_samp(lifetime) / sqrt(count(*)), 6) AS low,
    round(avg(lifetime) + 1.96 * stddev_samp(lifetime) / sqrt(count(*)), 6) AS high FROM {o_cve} GROUP BY 1""",
)
def q_mean_ci(t):
    out = st.mean_interval(_cves(t), ["category"], "lifetime")
    return out.select("category", r6("mean", "mean"), r6("low", "low"), r6("high", "high"))
