"""From fixing commits back to the commits that caused them.

A heuristic is a function from hunks and a blame table to ``(fix, blame_commit, weight)``; it is
picked by name from ``HEURISTICS``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions import text as x
from faultline.operators import diff as d
from faultline.operators.quantiles import median_and_mad
from faultline.operators.scan import falling, ordered_scan, row_number, running_sum
from faultline.session import stored


# --- fix-inducing changes ------------------------------------------------------------------------
def inducing_lines(removed: DataFrame, fixes: DataFrame, commits: DataFrame) -> DataFrame:
    """Removed lines of fixes that point at a commit: code lines only, blamed on a known commit that
    is not newer than the issue.

    ``removed`` (commit_id, path, code, blame_commit, line_a), ``fixes`` (commit_id, issue,
    issue_date), ``commits`` (commit_id, commit_date).
    """
    code = removed.filter(
        ~F.col("code").rlike(d.COMMENT_MARK) & (F.trim("code") != "") & F.col("blame_commit").isNotNull()
    )
    origin = commits.select(F.col("commit_id").alias("blame_commit"), F.col("commit_date").alias("blame_date"))
    return (
        code.join(fixes, "commit_id")
        .join(origin, "blame_commit")
        .filter(F.col("blame_date") <= F.col("issue_date"))
        .select(F.col("commit_id").alias("fix"), "issue", "path", "line_a", "blame_commit", "blame_date")
    )


def inducing_counts(lines: DataFrame) -> DataFrame:
    """Per blamed commit: lines, fixes and issues it is blamed for."""
    return lines.groupBy("blame_commit").agg(
        F.count(F.lit(1)).alias("bug_count"),
        F.count_distinct("fix").alias("n_fixes"),
        F.count_distinct("issue").alias("n_issues"),
    )


def issue_bound(counts: DataFrame) -> DataFrame:
    """median + 3 * 1.4826 * MAD of the issues per blamed commit; a MAD of 0 counts as 1."""
    m = median_and_mad(stored(counts.select("n_issues"), "issues"), [], "n_issues")
    mad = F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad"))
    return m.select("median", "mad", (F.col("median") + 3 * 1.4826 * mad).alias("upper"))


def time_bound(days: DataFrame, value: str) -> DataFrame:
    """median + 3 * MAD of the fix times."""
    m = median_and_mad(stored(days.select(value), "days"), [], value)
    return m.select("median", "mad", (F.col("median") + 3 * F.col("mad")).alias("upper"))


def fix_inducing(lines: DataFrame) -> DataFrame:
    """Blamed commits after outliers are taken out.

    The bound depends on the blamed commit alone, so counting again without the outliers equals
    dropping their rows from the first count.
    """
    counts = stored(inducing_counts(lines), "inducing_counts")
    upper = issue_bound(counts).select("upper").scalar()
    return counts.filter(F.col("n_issues") <= upper)


def fix_times(lines: DataFrame, commits: DataFrame) -> DataFrame:
    """Days from the blamed commit to each of its fixes."""
    pairs = lines.select("blame_commit", "blame_date", "fix").distinct()
    fixed = commits.select(F.col("commit_id").alias("fix"), F.col("commit_date").alias("fix_date"))
    return pairs.join(fixed, "fix").select(
        "blame_commit", "fix", F.date_diff("fix_date", "blame_date").alias("days")
    )


def fix_time_stats(days: DataFrame, value: str = "days", share: float = 0.1) -> DataFrame:
    """Mean, median and the value at place ``int(n * share)`` of the descending order."""
    counts = days.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = ordered_scan(
        counts, [], [falling("_v")], {"_upto": running_sum("_n")}, totals={"_all": running_sum("_n")}
    )
    n = F.col("_all")
    lo, hi = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    at = lambda i: F.max(F.when(F.col("_upto") > i, F.col("_v")))
    return run.agg(
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"),
        ((at(lo) + at(hi)) / 2).alias("median"),
        at(F.floor(n * F.lit(share))).cast("double").alias("at_share"),
    )


# --- blame heuristics ----------------------------------------------------------------------------
# ``version`` tells which text a line number belongs to: 0 is the commit itself, k its k-th parent.
# hunks: fix, parent_no, path, hunk_id, del_start, del_count, add_start, add_count, function, summary, cwe
# blame: commit_id, version, path, line_no, blame_commit   lines: commit_id, version, path, line_no, code
# blame may also come in blocks, as blame tools give it: commit_id, path, block and lists of equal length (version, line_no,
# blame_commit); a block holds the lines of which ``block_of`` is the same, in one row or more. Then a file travels as
# a few rows, not as one a line and version.
_SPOT = ["fix", "version", "path", "line_no"]
_BLOCK = ["fix", "path", "block"]


def block_of(line_no: Column) -> Column:
    return F.shiftright(line_no.cast("bigint"), 6)


def _deleted(hunks: DataFrame) -> DataFrame:
    """Deleted lines, to be looked up in the parent they were deleted from."""
    last = F.col("del_start") + F.col("del_count") - 1
    return (
        hunks.filter("del_count > 0")
        .withColumn("line_no", F.explode(F.sequence(F.col("del_start"), last)))
        .withColumn("version", F.col("parent_no"))
    )


def _around_additions(hunks: DataFrame) -> DataFrame:
    """The line before an added block, if there is one, and the line after it, in the commit."""
    added = hunks.filter("add_count > 0")
    before, after = F.col("add_start") - 1, F.col("add_start") + F.col("add_count")
    spots = F.filter(F.array(before, after), lambda n: n > 0)
    return added.withColumn("line_no", F.explode(spots)).withColumn("version", F.lit(0))


def _blame_counts(candidates: DataFrame, blame: DataFrame, weight: Column) -> DataFrame:
    """Weight per (fix, blamed commit); candidate lines that do not exist find no blame."""
    c = candidates.select(*_SPOT, weight.alias("_w"))
    if "block" in blame.columns:
        # dealt by block once, for the sums and for the join
        c = c.withColumn("block", block_of(F.col("line_no"))).repartition(*_BLOCK)
        c = c.groupBy(*_BLOCK, "version", "line_no").agg(F.sum("_w").alias("_w"))
        b = blame.select(
            F.col("commit_id").alias("fix"), "path", "block", F.col("version").alias("_versions"),
            F.col("line_no").alias("_lines"), F.col("blame_commit").alias("_commits"),
        )
        spots = F.arrays_zip(F.col("_versions").alias("v"), F.col("_lines").alias("n"), F.col("_commits").alias("c"))
        here = F.filter(spots, lambda s: (s["v"] == F.col("version")) & (s["n"] == F.col("line_no")))
        found = c.join(b, _BLOCK).select("fix", "_w", F.explode(here).alias("_s")).select("fix", "_w", F.col("_s.c").alias("blame_commit"))
    else:
        # equal candidates are summed before they meet the blame table
        c = c.groupBy(*_SPOT).agg(F.sum("_w").alias("_w"))
        found = c.join(blame.select(F.col("commit_id").alias("fix"), "version", "path", "line_no", "blame_commit"), _SPOT)
    return (
        found.groupBy("fix", "blame_commit")
        .agg(F.sum("_w").cast("bigint").alias("weight"))
    )


def _code_hunks(hunks: DataFrame) -> DataFrame:
    return hunks.filter(x.is_code_file(F.col("path")))


def heuristic_all_lines(hunks: DataFrame, blame: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Every deleted line and the lines around every addition count one, against every parent."""
    code = _code_hunks(hunks)
    both = _deleted(code).unionByName(_around_additions(code))
    return _blame_counts(both, blame, F.lit(1))


def _without_noise(code: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidate lines less comments and blanks. A single added line must hold a keyword or call, an
    added block must not declare a function."""
    masked = d.comment_mask(lines, ["commit_id", "version", "path"], "line_no", "code")
    # noise and text travel in blocks of a file, not as a row per line and version
    spot = F.struct(F.col("version").cast("int").alias("version"), F.col("line_no").cast("bigint").alias("line_no"))
    noise = masked.filter("masked").groupBy(F.col("commit_id").alias("fix"), "path", block_of(F.col("line_no")).alias("block")).agg(
        F.collect_set(spot).alias("_noise")
    )
    entry = F.struct(F.col("line_no").cast("bigint").alias("n"), "code")
    text = lines.filter("version = 0").groupBy(F.col("commit_id").alias("fix"), "path", block_of(F.col("line_no")).alias("block")).agg(
        F.collect_list(entry).alias("_text")
    )
    code_at = F.array_max(F.transform(F.filter("_text", lambda s: s["n"] == F.col("_l")), lambda s: s["code"]))
    # text of the first added line and of the two after it, in one join
    first3 = code.filter("add_count > 0").select("fix", "parent_no", "path", "hunk_id", "add_start", "add_count")
    spots = first3.withColumn("_l", F.explode(F.sequence(F.col("add_start"), F.col("add_start") + 2)))
    block = (
        spots.withColumn("block", block_of(F.col("_l"))).join(text, _BLOCK, "left").withColumn("code", code_at)
        .groupBy("fix", "parent_no", "path", "hunk_id", "add_count")
        .agg(
            F.max(F.when(F.col("_l") == F.col("add_start"), F.col("code"))).alias("_one"),
            F.concat_ws(
                "",
                *[F.max(F.when(F.col("_l") == F.col("add_start") + i, F.col("code"))) for i in range(3)],
            ).alias("_three"),
        )
    )
    single_ok = F.coalesce(d.worth_blaming(F.col("_one")), F.lit(False))
    declares = F.trim("_three").rlike("^" + x.FUNCTION_DEFINITION)
    keep = block.filter(
        F.when(F.col("add_count") == 1, single_ok).otherwise(~declares)
    ).select("fix", "parent_no", "path", "hunk_id")
    around = _around_additions(code.join(keep, ["fix", "parent_no", "path", "hunk_id"], "left_semi"))
    both = _deleted(code).unionByName(around)
    dealt = both.withColumn("block", block_of(F.col("line_no"))).join(noise, _BLOCK, "left")
    own = F.struct(F.col("version").cast("int").alias("version"), F.col("line_no").cast("bigint").alias("line_no"))
    return dealt.filter(~F.coalesce(F.array_contains("_noise", own), F.lit(False))).drop("_noise", "block")


def heuristic_code_lines(hunks: DataFrame, blame: DataFrame, lines: DataFrame) -> DataFrame:
    """As ``heuristic_all_lines``, without comment, blank and trivial lines."""
    return _blame_counts(_without_noise(_code_hunks(hunks), lines), blame, F.lit(1))


def heuristic_named_function(hunks: DataFrame, blame: DataFrame, lines: DataFrame, boost: int = 3) -> DataFrame:
    """As ``heuristic_code_lines`` against the first parent; a hunk whose function the summary names
    counts ``boost``."""
    first = _code_hunks(hunks).filter("parent_no = 1")
    named = (F.col("function") != "") & F.contains(F.lower(F.coalesce("summary", F.lit(""))), F.lower("function"))
    return _blame_counts(_without_noise(first, lines), blame, F.when(named, boost).otherwise(1))


def heuristic_with_confidence(
    hunks: DataFrame, blame: DataFrame, lines: DataFrame | None = None, excluded_cwe: Sequence[str] = ("264",), boost: int = 3
) -> DataFrame:
    """Blame counts with ``confident`` per fix: one commit leads alone; when there are others it
    leads by more than a third of all blame among fewer than five commits; the weakness class is
    not excluded."""
    code = _code_hunks(hunks)
    both = _deleted(code).unionByName(_around_additions(code))
    named = (F.col("function") != "") & F.contains(F.lower(F.coalesce("summary", F.lit(""))), F.lower("function"))
    counts = stored(_blame_counts(both, blame, F.when(named, boost).otherwise(1)), "blame_counts")
    levels = counts.groupBy("fix", "weight").agg(F.count(F.lit(1)).alias("_n"))
    top = levels.groupBy("fix").agg(
        F.max("weight").alias("_top"),
        F.max_by("_n", "weight").alias("_n_top"),
        F.count(F.lit(1)).alias("_levels"),
        F.sum("_n").alias("_commits"),
        F.sum(F.col("weight") * F.col("_n")).alias("_total"),
    )
    below = levels.join(top.select("fix", "_top"), "fix").filter(F.col("weight") < F.col("_top"))
    second = below.groupBy("fix").agg(F.max("weight").alias("_second"))
    cwe = hunks.groupBy("fix").agg(F.max("cwe").alias("_cwe"))
    judged = top.join(second, "fix", "left").join(cwe, "fix", "left")
    leads = (F.col("_levels") == 1) | (
        (F.col("_top") - F.col("_second") > F.col("_total") / 3) & (F.col("_commits") < 5)
    )
    allowed = ~F.coalesce(F.col("_cwe").isin(*excluded_cwe), F.lit(False))
    sure = allowed & (F.col("_n_top") == 1) & leads
    return counts.join(judged.select("fix", sure.alias("confident")), "fix")


def heuristic_lower_bound(hunks: DataFrame, blame: DataFrame, commits: DataFrame) -> DataFrame:
    """Newest commit among the blamed deleted lines: ``(fix, blame_commit, commit_date)``."""
    counts = _blame_counts(_deleted(hunks), blame, F.lit(1))
    dated = counts.join(
        commits.select(F.col("commit_id").alias("blame_commit"), "commit_date"), "blame_commit"
    )
    newest = F.max_by(F.struct("blame_commit", "commit_date"), F.struct("commit_date", "blame_commit"))
    return dated.groupBy("fix").agg(newest.alias("_b")).select("fix", "_b.*")


HEURISTICS: dict[str, Callable[..., DataFrame]] = {
    "all_lines": heuristic_all_lines,
    "code_lines": heuristic_code_lines,
    "named_function": heuristic_named_function,
    "with_confidence": heuristic_with_confidence,
}


def run_heuristic(name: str, hunks: DataFrame, blame: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    return HEURISTICS[name](hunks, blame, lines)


# --- mappings ------------------------------------------------------------------------------------
def cve_mappings(cves: DataFrame, configs: DataFrame, links: DataFrame, commits: DataFrame, limit: int | None = None) -> DataFrame:
    """CVE x project x link x commit, each combination once; a limit takes the first by CVE and sha."""
    out = (
        links.join(cves, "cve")
        .join(configs, "config")
        .join(commits, ["sha", "config"])
        .select("cve", "config", "config_name", "sha", "commit_date")
        .distinct()
    )
    return out if limit is None else out.orderBy("cve", "sha", "config").limit(limit)


def map_by_ids(texts: DataFrame, key: str, ids: Column, known: DataFrame) -> DataFrame:
    """Texts to CVEs through the ids found in them. ``known`` has (id, cve)."""
    found = texts.select(key, F.explode(F.array_distinct(ids)).alias("id"))
    return found.join(known.select("id", "cve").distinct(), "id").select(key, "id", "cve")


def ids_from_references(refs: DataFrame, rules: Sequence[dict], block: int = 1000) -> DataFrame:
    """Reference links to ids, and the CVEs of each id as lists.

    A list holds at most ``block`` CVEs; an id with more has several rows, numbered by ``part``, so
    that no row outgrows a task.
    """
    pairs = refs.select("cve", F.explode(x.extract_ids(F.col("reference"), rules)).alias("id")).distinct()
    return blocked_lists(pairs, ["id"], ["cve"], "cve", block, "cves")


def blocked_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column, block: int, name: str) -> DataFrame:
    """Values per key as ordered lists of at most ``block`` entries; ``part`` numbers the lists."""
    ranked = ordered_scan(df, keys, order, {"_rn": row_number()})
    ranked = ranked.withColumn("part", F.floor((F.col("_rn") - 1) / block).cast("int"))
    entry = F.struct(F.col("_rn"), (F.col(value) if isinstance(value, str) else value).alias("v"))
    return ranked.groupBy(*keys, "part").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(name)
    )


def map_by_sha(known: DataFrame, commits: DataFrame) -> DataFrame:
    """(sha, cve) pairs with a flag that tells whether the repository has the commit."""
    have = commits.select("sha", F.lit(True).alias("_have")).distinct()
    return known.distinct().join(have, "sha", "left").select(
        "sha", "cve", F.coalesce("_have", F.lit(False)).alias("in_repository")
    )


def merge_maps(maps: Sequence[DataFrame]) -> DataFrame:
    """Several (id, value) sources as one, each pair with the number of sources naming it."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out.groupBy("id", "value").agg(F.count(F.lit(1)).alias("n_sources"))


def advisory_flags(cves: DataFrame, advisories: DataFrame, pattern: str) -> DataFrame:
    """Is a CVE named by an advisory, and what does the last one say? Ids are taken out of the
    advisory text and joined by equality."""
    named = advisories.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("cve"),
        "advisory_id",
        "is_vulnerable",
    )
    last = named.groupBy("cve").agg(F.max_by("is_vulnerable", "advisory_id").alias("stable"))
    return cves.join(last, "cve", "left").withColumn("stable", F.coalesce("stable", F.lit("no")))


def fix_flags(messages: DataFrame, key: str, pattern: str, issues: DataFrame) -> DataFrame:
    """``fix`` and the last known issue named in the message. ``issues`` has ``issue``."""
    ids = messages.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "issue"))
    ids = ids.withColumn("issue", F.trim("issue"))
    known = ids.join(issues.select("issue").distinct(), "issue", "left_semi")
    last = known.groupBy(key).agg(F.max_by("issue", "pos").alias("fix_issue"))
    return messages.select(key).join(last, key, "left").select(
        key, F.col("fix_issue").isNotNull().cast("int").alias("fix"), F.coalesce("fix_issue", F.lit("")).alias("fix_issue")
    )


def mapping_coverage(ids: DataFrame, matched: DataFrame, key: str, id_col: str) -> DataFrame:
    """Distinct ids found, ids and rows matched, and the matched share in percent."""
    hit = matched.select(id_col).distinct().withColumn("_hit", F.lit(1))
    joined = ids.join(hit, id_col, "left")
    per_id = joined.groupBy(id_col).agg(F.max("_hit").alias("_hit"), F.count(F.lit(1)).alias("_n"))
    return per_id.agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.count_if(F.col("_hit") == 1).alias("n_matched"),
        F.sum(F.when(F.col("_hit") == 1, F.col("_n")).otherwise(0)).alias("rows_matched"),
        (100.0 * F.count_if(F.col("_hit") == 1) / F.count(F.lit(1))).alias("pct_matched"),
    )


def unusual_messages(mapped: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """Mappings whose message carries the CVE in none of the accepted phrases (patterns put before
    the id)."""
    fits = F.lit(False)
    for p in phrases:
        fits = fits | F.rlike("message", F.concat(F.lit(p), F.col("cve")))
    return mapped.filter(~fits)


def commit_distance(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits between ``older`` and ``newer`` on a linear history per project."""
    placed = stored(
        ordered_scan(
            commits.select("project", "commit_id", "commit_date"), ["project"], ["commit_date", "commit_id"], {"place": row_number()}
        ),
        "places",
    )
    a = placed.select(F.col("commit_id").alias("older"), F.col("project").alias("_p"), F.col("place").alias("_a"))
    b = placed.select(F.col("commit_id").alias("newer"), F.col("project").alias("_q"), F.col("place").alias("_b"))
    return (
        pairs.join(a, "older")
        .join(b, "newer")
        .filter(F.col("_p") == F.col("_q"))
        .select("older", "newer", (F.col("_b") - F.col("_a")).alias("distance"))
    )
