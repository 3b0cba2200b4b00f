"""Labelled commit datasets: building, splitting, mixing and describing them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.hashing import hash_key
from faultline.operators.scan import falling, ordered_scan, row_number


def heuristic_filter(include_heuristics: bool, excluded_types: Sequence[str] = ()) -> Column:
    """Keep links found by people; with ``include_heuristics`` keep all."""
    if include_heuristics:
        return F.lit(True)
    keep = ~F.col("determined_by_heuristic")
    return keep & ~F.col("mapping_type").isin(*excluded_types) if excluded_types else keep


def projects_with_enough(links: DataFrame, threshold: int, keep: Column) -> DataFrame:
    """Projects with at least ``threshold`` distinct contributing commits, most first."""
    return (
        links.filter(F.col("vcc_sha").isNotNull() & keep)
        .groupBy("config_code")
        .agg(F.count_distinct("vcc_sha").alias("num_vccs"))
        .filter(F.col("num_vccs") >= threshold)
        .orderBy(F.col("num_vccs").desc(), "config_code")
    )


def contributing_commits(
    links: DataFrame, commits: DataFrame, keep: Column, project: str | None = None
) -> DataFrame:
    """Contributing commits with date and their distinct sources as one text, newest first.

    ``links`` (vcc_sha, config_code, mapping_type, determined_by_heuristic);
    ``commits`` (com_sha, com_config_code, com_date). Without ``project`` all projects are exported,
    each against its own commits.
    """
    wanted = links.filter(F.col("vcc_sha").isNotNull() & keep)
    if project is not None:
        wanted = wanted.filter(F.col("config_code") == project)
    # one row per (commit, source) before the join: a commit linked many times moves once
    slim = wanted.select("vcc_sha", "config_code", "mapping_type").distinct()
    joined = slim.join(
        commits,
        (slim["vcc_sha"] == commits["com_sha"]) & (slim["config_code"] == commits["com_config_code"]),
    )
    # the set is as small as the list of source kinds
    return (
        joined.groupBy(
            "config_code", F.col("vcc_sha").alias("commit_id"), F.col("com_date").alias("commit_date")
        )
        .agg(F.array_join(F.array_sort(F.collect_set("mapping_type")), ",").alias("sources"))
        .orderBy(F.col("commit_date").desc(), "commit_id")
    )


def without_known(candidates: DataFrame, known: DataFrame, key: str = "commit_id") -> DataFrame:
    """Candidates that are not known to be vulnerable."""
    return candidates.join(known.select(key).distinct(), key, "left_anti")


def combine_labelled(vulnerable: DataFrame, safe: DataFrame, key: str = "commit_id") -> DataFrame:
    """Label both sides, drop safe commits that are vulnerable, newest first."""
    pos = vulnerable.withColumn("label", F.lit(1))
    neg = without_known(safe, vulnerable, key).withColumn("label", F.lit(0))
    return pos.unionByName(neg).orderBy(F.col("commit_date").desc(), key)


def temporal_split(df: DataFrame, test_fraction: float, key: str = "commit_id") -> DataFrame:
    """Add ``is_test``: the most recent ``floor(n * fraction)`` rows, ids breaking ties."""
    ranked = ordered_scan(
        df, [], [falling("commit_date"), key], {"_rn": row_number()}, totals={"_n": row_number()}
    )
    n_test = F.floor(F.col("_n") * F.lit(test_fraction))
    return ranked.withColumn("is_test", F.col("_rn") <= n_test).drop("_rn", "_n")


def random_split(
    df: DataFrame, fraction: float, seed: int, key: str = "commit_id", name: str = "is_validation"
) -> DataFrame:
    """Mark ``ceil(n * fraction)`` rows, chosen by seeded hash order."""
    ranked = ordered_scan(
        df.withColumn("_h", hash_key(seed, F.col(key))), [], ["_h", key], {"_rn": row_number()}, totals={"_n": row_number()}
    )
    n = F.ceil(F.col("_n") * F.lit(fraction))
    return ranked.withColumn(name, F.col("_rn") <= n).drop("_rn", "_n", "_h")


def three_way_split(
    df: DataFrame, validation: float, test: float, seed: int, key: str = "commit_id"
) -> DataFrame:
    """Column ``split``: newest rows test, the rest split at random into train and validation."""
    dated = temporal_split(df, test, key)
    rest = dated.filter(~F.col("is_test")).drop("is_test")
    rest = random_split(rest, validation / (1.0 - test), seed, key)
    part = F.when(F.col("is_validation"), "validation").otherwise("train")
    newest = dated.filter("is_test").drop("is_test").withColumn("split", F.lit("test"))
    return newest.unionByName(rest.withColumn("split", part).drop("is_validation"))


def except_subset(df: DataFrame, subset: DataFrame) -> DataFrame:
    """Rows of ``df`` less the rows of ``subset``, duplicates counted."""
    return df.exceptAll(subset)


def rebuild_full(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def mix_projects(named: dict[str, DataFrame]) -> DataFrame:
    """Union of per-project frames with the project as a column."""
    return rebuild_full([df.withColumn("project", F.lit(name)) for name, df in named.items()])


def leave_one_project_out(df: DataFrame) -> DataFrame:
    """For each project the rows of all other projects, under ``held_out``."""
    # the list of projects is a dimension, one entry per project
    names = df.select("project").distinct().agg(F.sort_array(F.collect_list("project"))).scalar()
    others = F.filter(F.col("_all"), lambda p: p != F.col("project"))
    return df.withColumn("_all", names).withColumn("held_out", F.explode(others)).drop("_all")


def class_balance(df: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Counts and percentages by label; a missing class counts zero."""
    pct = lambda c: F.try_divide(F.lit(100.0) * F.col(c), F.col("n"))
    return (
        df.groupBy(*keys)
        .agg(
            F.count_if(F.col("label") == 1).alias("n_pos"),
            F.count_if(F.col("label") == 0).alias("n_neg"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("pct_pos", pct("n_pos"))
        .withColumn("pct_neg", pct("n_neg"))
    )


def split_summary(df: DataFrame) -> DataFrame:
    """Counts for every (split, project), every split and the whole, in one pass."""
    return df.rollup("split", "project").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_pos")
    )


def month_counts(df: DataFrame, date: str = "commit_date") -> DataFrame:
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )


def month_deficit(df: DataFrame, ratio: float, date: str = "commit_date") -> DataFrame:
    """Labels per month side by side and how many safe commits the ratio still asks for."""
    by_month = (
        df.groupBy(F.year(date).alias("year"), F.month(date).alias("month"))
        .pivot("label", [0, 1])
        .count()
        .na.fill(0)
        .withColumnsRenamed({"0": "n_neg", "1": "n_pos"})
    )
    # halves go to the even neighbour
    return by_month.withColumn("to_add", F.bround(F.col("n_pos") * ratio - F.col("n_neg"), 0))


def safe_needed(df: DataFrame, ratio: float) -> DataFrame:
    """How many safe commits to add over all; negative means the ratio is met already."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    need = (pos * F.lit(ratio) - neg - 1).cast("bigint")
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"), need.alias("to_add"))


def backfill(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Fill nulls of ``column`` from ``lookup`` (key, column); tells which rows were filled."""
    found = lookup.select(key, F.col(column).alias("_found"))
    return (
        df.join(found, key, "left")
        .withColumn("was_missing", F.col(column).isNull())
        .withColumn(column, F.coalesce(F.col(column), F.col("_found")))
        .drop("_found")
    )


def outer_first_non_null(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join; each shared column takes the left value, else the right one."""
    shared = [c for c in left.columns if c != key]
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in shared])
    joined = left.join(r, key, "full")
    return joined.select(key, *[F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) for c in shared])


def split_by_membership(df: DataFrame, membership: DataFrame, key: str) -> DataFrame:
    """Rows whose id is listed, with the split it is listed under."""
    return df.join(membership.select(key, "split"), key)


def aligned(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose id the other input has as well."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def position_folds(df: DataFrame, order: Sequence, k: int = 5) -> DataFrame:
    """Contiguous folds of ``floor(n / k)`` rows; the remainder has fold null (training only)."""
    ranked = ordered_scan(df, [], order, {"_rn": row_number()}, totals={"_n": row_number()})
    fold = F.floor((F.col("_rn") - 1) / F.floor(F.col("_n") / k)).cast("int")
    return ranked.withColumn("fold", F.when(fold < k, fold)).drop("_rn", "_n")


def recent_windows(df: DataFrame, keys: Sequence[str], order_desc: Sequence, train: int, test: int) -> DataFrame:
    """The newest ``test`` rows per key and the ``train`` rows before them."""
    ranked = ordered_scan(df, keys, order_desc, {"_rn": row_number()})
    part = F.when(F.col("_rn") <= test, "test").when(F.col("_rn") <= train + test, "train")
    return ranked.withColumn("part", part).filter(F.col("part").isNotNull()).drop("_rn")


def filter_audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows each rule removes, the rows that pass all, and their share; one pass."""
    passes = reduce(lambda a, b: a & ~b, rules.values(), F.lit(True))
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n"),
        *[F.count_if(rule).alias(name) for name, rule in rules.items()],
        F.count_if(passes).alias("kept"),
        F.try_divide(F.count_if(passes).cast("double"), n).alias("kept_share"),
    )


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Booleans become 0/1, nulls the mean of their column."""
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds[c] == "boolean":
            df = df.withColumn(c, F.col(c).cast("int"))
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    out = df.withColumn("_mean", means)
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col("_mean")[c]))
    return out.drop("_mean")


def feature_subset(df: DataFrame, drop: Sequence[str] = (), only: Sequence[str] = (), ids: Sequence[str] = ()) -> DataFrame:
    """Keep only some features, or all but some; id columns always stay."""
    keep = [c for c in df.columns if c in ids or (c in only if only else c not in drop)]
    return df.select(*keep)


def set_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of the intersection and both differences of two id sets, by one grouped union."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    flags = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return flags.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both"),
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
    )
