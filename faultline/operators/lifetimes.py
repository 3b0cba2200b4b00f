"""Vulnerability lifetimes: blame summaries, CVE-level records, tables and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.quantiles import exact_quantiles
from faultline.operators.user_aggregate import Aggregate, user_aggregate
from faultline.session import cut_lineage

GROUND_DATE = "1900-01-01"

# Names of the categories.
CATEGORY_NAMES = {
    1: "Memory and Resource Management",
    2: "Input Validation and Sanitization",
    3: "Code Development Quality",
    4: "Security Measures",
    5: "Others",
    6: "Concurrency",
}
# Category of each weakness class.
CWE_CATEGORY = {
    "16": 5, "17": 3, "19": 5, "20": 2, "22": 2, "59": 2, "74": 2, "77": 2, "78": 2, "79": 4, "89": 2, "91": 2, "92": 4,
    "93": 2, "94": 2, "119": 1, "120": 1, "125": 1, "129": 2, "134": 5, "189": 4, "190": 1, "191": 1, "193": 3, "199": 5,
    "200": 4, "203": 4, "252": 5, "254": 4, "255": 4, "264": 4, "269": 4, "275": 4, "276": 4, "281": 4, "284": 4,
    "285": 4, "287": 4, "290": 4, "295": 5, "310": 4, "311": 4, "319": 4, "320": 4, "327": 4, "330": 5, "345": 5,
    "346": 5, "347": 4, "352": 5, "354": 5, "358": 4, "361": 6, "362": 6, "369": 3, "388": 5, "391": 5, "399": 1,
    "400": 1, "404": 1, "415": 1, "416": 1, "417": 5, "426": 4, "427": 5, "434": 5, "476": 1, "502": 2, "522": 4,
    "532": 5, "534": 5, "538": 4, "601": 4, "610": 5, "617": 3, "664": 1, "665": 5, "668": 4, "674": 3, "682": 3,
    "704": 5, "706": 5, "707": 2, "732": 4, "754": 5, "755": 5, "763": 1, "770": 1, "772": 1, "787": 1, "824": 1,
    "829": 5, "834": 3, "835": 3, "843": 5, "862": 4, "863": 4, "918": 5, "922": 4, "1021": 5, "1187": 1, "NVD-Other": 5,
}


def category_table(spark) -> DataFrame:
    """(cwe, cat, cat_name): one row per known weakness class."""
    rows = [(cwe, cat, CATEGORY_NAMES[cat]) for cwe, cat in CWE_CATEGORY.items()]
    return spark.createDataFrame(rows, "cwe_id string, cat int, cat_name string")


def with_category(df: DataFrame, cwe: str) -> DataFrame:
    """Adds the category of ``CWE-n`` text; unknown classes stay null."""
    table = F.broadcast(category_table(df.sparkSession))  # fixed table, about a hundred rows
    return df.withColumn("cwe_id", F.regexp_replace(cwe, "^CWE-", "")).join(table, "cwe_id", "left").drop("cwe_id")


def primary_parents(relations: DataFrame) -> DataFrame:
    """(node, parent) of relations (node, parent, nature, ordinal, position): the first primary ``ChildOf`` one of a node."""
    kept = relations.filter((F.col("nature") == "ChildOf") & (F.col("ordinal") == "Primary"))
    return kept.groupBy("node").agg(F.min_by("parent", F.struct("position", "parent")).alias("parent"))


def roots(edges: DataFrame) -> DataFrame:
    """Topmost ancestor of each node of ``edges`` (node, parent). Nodes without parent are their own root and not listed;
    of several parents the smallest counts (``primary_parents`` chooses by rank).

    Every round doubles the distance looked ahead, until no root has a parent. A cycle has no root and raises."""
    jump = edges.groupBy("node").agg(F.min("parent").alias("root"))
    reach, nodes = 1, None
    while True:
        jump = cut_lineage(jump)
        ahead = jump.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        joined = jump.join(ahead, "root", "left")
        if not joined.filter(F.col("_next").isNotNull()).limit(1).count():
            return jump
        nodes = nodes or jump.count()
        if reach > nodes:
            raise ValueError("the edges have a cycle")
        jump, reach = joined.select("node", F.coalesce("_next", "root").alias("root")), 2 * reach


def blame_summary(counts: DataFrame, commits: DataFrame) -> DataFrame:
    """Per fix: most blamed, oldest and newest commit with dates, mean and weighted mean date.

    ``counts`` (fix, blame_commit, weight). Ties go to the smaller commit id.
    """
    dated = counts.join(
        commits.select(F.col("commit_id").alias("blame_commit"), F.to_date("commit_date").alias("day")), "blame_commit"
    )
    who = F.struct("blame_commit", "day")
    since = F.date_diff("day", F.lit(GROUND_DATE).cast("date"))
    s = dated.groupBy("fix").agg(
        F.min_by(who, F.struct(-F.col("weight"), "blame_commit")).alias("_m"),
        F.min_by(who, F.struct("day", "blame_commit")).alias("_o"),
        F.min_by(who, F.struct(-F.unix_date("day"), F.col("blame_commit"))).alias("_n"),
        F.avg(since).alias("_avg"),
        (F.sum(since * F.col("weight")) / F.sum("weight")).alias("_wavg"),
    )
    at = lambda days: F.date_add(F.lit(GROUND_DATE).cast("date"), F.floor(days).cast("int"))
    return s.select(
        "fix",
        F.col("_m.blame_commit").alias("most_blamed"),
        F.col("_m.day").alias("most_blamed_date"),
        F.col("_o.blame_commit").alias("oldest"),
        F.col("_o.day").alias("oldest_date"),
        F.col("_n.blame_commit").alias("newest"),
        F.col("_n.day").alias("newest_date"),
        at(F.col("_avg")).alias("average_date"),
        at(F.col("_wavg")).alias("weighted_date"),
    )


def lifetime_records(
    links: DataFrame, summary: DataFrame, commits: DataFrame, distances: DataFrame, info: DataFrame, stable: DataFrame
) -> DataFrame:
    """One row per (cve, fix) with all dates, commit counts, weakness data and the stable flag.

    ``distances`` (older, newer, distance), ``info`` (cve, cwe, score), ``stable`` (cve, stable).
    """
    fixed = commits.select(F.col("commit_id").alias("fix"), F.to_date("commit_date").alias("fix_date"))
    out = links.join(summary, "fix").join(fixed, "fix")
    for which in ("most_blamed", "oldest", "newest"):
        d = distances.select(
            F.col("older").alias(which), F.col("newer").alias("fix"), F.col("distance").alias(f"{which}_commits")
        )
        out = out.join(d, ["fix", which], "left")
    return (
        out.join(info, "cve", "left")
        .join(stable, "cve", "left")
        .withColumn("stable", F.coalesce("stable", F.lit("no")))
    )


def cve_lifetimes(records: DataFrame, keys: Sequence[str] = ("project", "cve")) -> DataFrame:
    """CVE level: latest fix, earliest origins, estimated, true, chosen and lower-bound lifetime.

    ``records`` has fix_date, est_date, true_date, newest_date, category, score, stable, and fix, nr
    as order of the rows. The true lifetime is chosen when it is positive; a negative one counts 0.
    """
    order = F.struct("fix", "nr")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    g = records.groupBy(*keys).agg(
        F.max("fix_date").alias("latest_fix"),
        F.min("est_date").alias("h_oldest"),
        F.min("true_date").alias("t_oldest"),
        F.min("newest_date").alias("_lower"),
        first("category").alias("category"),
        F.min_by("score", order).alias("score"),
        F.min_by("stable", order).alias("stable"),
        F.bool_and("confident").alias("confident"),
        F.count(F.lit(1)).alias("n_fixes"),
    )
    days = lambda d: F.date_diff("latest_fix", d)
    return (
        g.withColumn("fix_year", F.year("latest_fix"))
        .withColumn("h_lifetime", days("h_oldest"))
        .withColumn("_c", days("t_oldest"))
        .withColumn("lifetime", F.when(F.col("_c") > 0, F.col("_c")).otherwise(F.col("h_lifetime")))
        .withColumn("c_lifetime", F.greatest(F.col("_c"), F.when(F.col("_c").isNotNull(), F.lit(0))))
        .withColumn("lifetime_lower", days("_lower"))
        .drop("_c", "_lower")
    )


def stable_only(records: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Records that hit a stable release; count texts become numbers, empty ones 0."""
    out = records.filter(F.contains(F.col("stable"), F.lit("yes")))
    for c in counts:
        out = out.withColumn(c, F.coalesce(F.col(c).try_cast("int"), F.lit(0)))
    return out


def _summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    stats = df.groupBy(*keys).agg(
        F.avg(v).alias("average"),
        F.stddev_pop(v).alias("deviation"),
        F.var_samp(v).alias("variance"),
        F.count(v).alias("n"),
    )
    med = exact_quantiles(df, keys, value, {"median": 0.5})
    return stats.join(med, list(keys)) if keys else stats.withColumn("median", med.scalar())


def lifetime_table(df: DataFrame, field: str, value: str = "lifetime") -> DataFrame:
    """Mean, median, deviation and variance by ``field``, then the plain mean of these rows and the
    figures over all rows."""
    cols = ["average", "median", "deviation", "variance"]
    df = cut_lineage(df.select(field, value))
    by = _summary(df.filter(F.col(field).isNotNull()), [field], value).select(F.col(field).cast("string").alias(field), *cols)
    macro = by.agg(*[F.avg(c).alias(c) for c in cols]).select(F.lit("Macro Avg.").alias(field), *cols)
    overall = _summary(df, [], value).select(F.lit("Overall").alias(field), *cols)
    return by.unionByName(macro).unionByName(overall)


def lifetime_quantiles(df: DataFrame, value: str = "lifetime") -> DataFrame:
    """Mean, quartiles, mean absolute deviation and the share of rows at or below the mean."""
    df = cut_lineage(df.select(value))
    mean = df.agg(F.avg(value)).scalar()
    q = exact_quantiles(df, [], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = df.agg(
        F.avg(value).alias("mean"),
        F.avg(F.abs(F.col(value) - mean)).alias("mean_deviation"),
        (100.0 * F.count_if(F.col(value) <= mean) / F.count(value)).alias("pct_up_to_mean"),
    )
    return out.withColumn("_q", q.select(F.struct("q1", "median", "q3")).scalar()).select(
        "mean", "mean_deviation", "pct_up_to_mean", "_q.q1", "_q.median", "_q.q3"
    )


def yearly(df: DataFrame, year: str, value: str, min_rows: int = 20, estimator: str | Column | Aggregate = "mean") -> DataFrame:
    """Mean, median (by name), any aggregate expression or a user's aggregate per year, for years with enough rows."""
    if isinstance(estimator, Aggregate):
        n = df.groupBy(year).agg(F.count(value).alias("n")).filter(F.col("n") >= min_rows)
        return n.join(user_aggregate(df, [year], [value], estimator), year)
    own = F.avg(value) if isinstance(estimator, str) else estimator
    n = df.groupBy(year).agg(F.count(value).alias("n"), own.alias("value"))
    if isinstance(estimator, str) and estimator == "median":
        n = n.drop("value").join(exact_quantiles(df, [year], value, {"value": 0.5}), year)
    elif isinstance(estimator, str) and estimator != "mean":
        raise ValueError(f"unknown estimator: {estimator}")
    return n.filter(F.col("n") >= min_rows)


def year_mix(df: DataFrame) -> DataFrame:
    """Per year: mean of the true lifetime where known, else of the estimate, and the share known."""
    known = F.col("c_lifetime").isNotNull()
    return df.groupBy("fix_year").agg(
        F.avg(F.coalesce("c_lifetime", "h_lifetime")).alias("mean_combined"),
        F.count_if(known).alias("n_true"),
        F.count_if(~known).alias("n_estimated"),
        (100.0 * F.count_if(known) / F.count(F.lit(1))).alias("pct_true"),
    )


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles, whiskers (outermost rows within 1.5 box heights) and rows beyond, per key."""
    df = cut_lineage(df.select(key, value))
    q = exact_quantiles(df, [key], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # equal values are counted first: the join moves one row per distinct value
    counts = df.groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(lo, hi)
    return counts.join(q, key).groupBy(key, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_n")).otherwise(0)).alias("n_outside"),
    )


def code_age(lines: DataFrame, references: Sequence[str], key: str = "project") -> DataFrame:
    """Mean age in days of all lines that exist at each reference date. ``lines`` (key, day, n_lines).

    Lines are summed per day first; every reference date is a conditional sum in the same pass.
    """
    days = lines.groupBy(key, "day").agg(F.sum("n_lines").alias("n"))
    aggs = []
    for i, ref in enumerate(references):
        at = F.lit(ref).cast("date")
        there = F.col("day") <= at
        aggs += [
            F.sum(F.when(there, F.date_diff(at, F.col("day")) * F.col("n"))).alias(f"d{i}"),
            F.sum(F.when(there, F.col("n"))).alias(f"n{i}"),
        ]
    rows = F.array(
        *[
            F.struct(F.lit(ref).cast("date").alias("reference"), F.try_divide(F.col(f"d{i}").cast("double"), F.col(f"n{i}")).alias("age"))
            for i, ref in enumerate(references)
        ]
    )
    return days.groupBy(key).agg(*aggs).select(key, F.inline(rows)).filter(F.col("age").isNotNull())


def top_categories(df: DataFrame, field: str, k: int) -> DataFrame:
    """The ``k`` largest categories with their mean lifetime."""
    return (
        df.groupBy(field)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("lifetime").alias("mean_lifetime"))
        .orderBy(F.col("n").desc(), field)
        .limit(k)
    )


def moving_average(points: DataFrame, index: str, value: str, n: int) -> DataFrame:
    """Mean of each value and the ``n - 1`` before it; the first places have none. ``index`` is
    dense. Every point is sent to the places it is part of, so no global order is needed."""
    spread = points.select(F.explode(F.sequence(F.col(index), F.col(index) + n - 1)).alias(index), value)
    last = points.agg(F.max(index)).scalar()
    return (
        spread.groupBy(index)
        .agg(F.avg(value).alias("moving"), F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") == n) & (F.col(index) <= last))
        .drop("_n")
    )


def match_rates(df: DataFrame) -> DataFrame:
    """How often the estimate hits the true date, and how often the bounds hold."""
    known = df.filter(F.col("true_date").isNotNull())
    share = lambda c: F.avg(c.cast("double"))
    t = F.col("true_date")
    return known.agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("est_date") == t).alias("exact"),
        share(F.col("oldest_date") <= t).alias("upper_holds"),
        share(F.col("newest_date") >= t).alias("lower_holds"),
    )


def error_distribution(df: DataFrame, keys: Sequence[str], estimate: str, relative: bool = False) -> DataFrame:
    """Mean, deviation and mean absolute error of true minus estimated date in days, or in percent of
    the true lifetime."""
    known = df.filter(F.col("true_date").isNotNull() & F.col(estimate).isNotNull())
    err = F.date_diff("true_date", estimate).cast("double")
    if relative:
        life = F.date_diff("fix_date", "true_date")
        known, err = known.filter(life != 0), err / life * 100
    return known.groupBy(*keys).agg(
        F.avg(err).alias("mean_error"),
        F.stddev_pop(err).alias("deviation"),
        F.avg(F.abs(err)).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    )


def score_bucket(score: Column) -> Column:
    """Whole score, halves to the even neighbour."""
    return F.bround(score, 0)


def patched(df: DataFrame, key: str, drop: Sequence, patches: dict, column: str) -> DataFrame:
    """Drop listed ids, replace known wrong values of ``column``."""
    spark = df.sparkSession
    types = dict(df.dtypes)
    fixes = spark.createDataFrame(list(patches.items()), f"{key} {types[key]}, _new {types[column]}")
    kept = df.filter(~F.col(key).isin(*drop)) if drop else df
    return kept.join(F.broadcast(fixes), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
