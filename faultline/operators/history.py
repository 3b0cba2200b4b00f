"""Process metrics of a change, from the history before and with it.

Input is one row per (commit_id, path) with author, commit_date and line counts. "So far" includes
the current commit. Order is (commit_date, commit_id). All running values come from ``ordered_scan``,
so a bot author or a changelog file that owns a large share of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions import text as x
from faultline.operators.decay import decayed_sum
from faultline.operators.scan import ordered_scan, previous, row_number, running_sum
from faultline.session import stored

WHEN = ["commit_date", "commit_id"]


def change_size(changes: DataFrame) -> DataFrame:
    """Lines added, deleted and before the change, per commit."""
    return changes.groupBy("commit_id").agg(
        F.sum("lines_added").alias("la"),
        F.sum("lines_deleted").alias("ld"),
        F.sum("lines_before").alias("lt"),
    )


def _entropy() -> Column:
    """Shannon entropy (log2) of the changed lines over files: log2(T) - sum(x log2 x) / T."""
    n = F.col("lines_added") + F.col("lines_deleted")
    total = F.sum(n)
    spread = F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0))
    return F.when(total > 0, F.log2(total) - spread / total).otherwise(0.0)


def entropy(changes: DataFrame) -> DataFrame:
    return changes.groupBy("commit_id").agg(_entropy().alias("entropy"))


def path_counts(changes: DataFrame) -> DataFrame:
    """Distinct subsystems, directories and file names per commit."""
    p = F.col("path")
    return changes.groupBy("commit_id").agg(
        F.count_distinct(x.subsystem(p)).alias("ns"),
        F.count_distinct(x.directory(p)).alias("nd"),
        F.count_distinct(x.file_name(p)).alias("nf"),
    )


def own_metrics(changes: DataFrame) -> DataFrame:
    """What a commit shows by itself, in one pass: spread over subsystems, directories and files,
    entropy and sizes. The distinct parts are sets of one commit, united in the tasks before the shuffle: distinct counts
    would send every row once per count."""
    p = F.col("path")
    parts = {"ns": x.subsystem(p), "nd": x.directory(p), "nf": x.file_name(p)}
    return changes.groupBy("commit_id", "author", "commit_date").agg(
        *[F.size(F.collect_set(part)).cast("bigint").alias(name) for name, part in parts.items()],
        _entropy().alias("entropy"),
        F.sum("lines_added").alias("la"),
        F.sum("lines_deleted").alias("ld"),
        F.sum("lines_before").alias("lt"),
    )


def first_touches(changes: DataFrame) -> DataFrame:
    """When each author first touched each file: ``(path, author, first)``; a plain minimum, so it
    is combined before the shuffle."""
    return changes.groupBy("path", "author").agg(F.min(F.struct(*WHEN)).alias("first"))


def own_touches(changes: DataFrame) -> DataFrame:
    """``changes`` with ``own_changes``: how often the author has changed the file so far. Written, as several metrics start
    from it."""
    return stored(ordered_scan(changes, ["path", "author"], WHEN, {"own_changes": row_number()}), "own")


def file_history(changes: DataFrame) -> DataFrame:
    """Per (commit, path): how often the file was changed so far, when before, by how many authors."""
    return _file_history(own_touches(changes)).drop("own_changes")


def _file_history(touches: DataFrame) -> DataFrame:
    """`file_history` of rows that have ``own_changes``, which stays. A file without a name has no authors."""
    new = (F.col("own_changes") == 1) & F.col("path").isNotNull() & F.col("commit_id").isNotNull()
    return ordered_scan(
        touches,
        ["path"],
        WHEN,
        {
            "file_changes": row_number(),
            "prev_date": previous("commit_date"),
            "file_authors": running_sum(new.cast("int")),
        },
    )


def days_between(later: Column, earlier: Column) -> Column:
    """Days with their fraction."""
    seconds = lambda c: c.cast("timestamp").cast("double")
    return (seconds(later) - seconds(earlier)) / 86_400


def changes_and_age(history: DataFrame) -> DataFrame:
    """``nuc``: changes to the touched files so far; ``age``: mean days since they were last touched
    (0 for a new file)."""
    gap = F.greatest(days_between(F.col("commit_date"), F.col("prev_date")), F.lit(0.0))
    return history.groupBy("commit_id").agg(
        F.sum("file_changes").alias("nuc"), F.avg(F.coalesce(gap, F.lit(0.0))).alias("age")
    )


def developers(changes: DataFrame, history: DataFrame, block: int = 512, in_row: int = 4096) -> DataFrame:
    """``ndev``: distinct authors so far over all files of the commit. ``history`` is `file_history` of ``changes``."""
    first = stored(first_touches(changes), "first_touches")
    places = ordered_scan(first, ["path"], ["first"], {"_nth": row_number()}).select("path", "_nth", "author", "first")
    return _developers(stored(places, "places"), history, block, in_row)


def _new_authors(history: DataFrame) -> DataFrame:
    """Each author's first touch of each file, and its place among the file's authors: what the rows of `_file_history` say
    already."""
    return history.filter((F.col("own_changes") == 1) & F.col("path").isNotNull() & F.col("commit_id").isNotNull()).select(
        "path", F.col("file_authors").alias("_nth"), "author", F.struct(*WHEN).alias("first")
    )


def _developers(places: DataFrame, history: DataFrame, block: int = 512, in_row: int = 4096) -> DataFrame:
    """The authors of a file so far are the first ``file_authors`` entries of its author list in order
    of first touch (``places``). The lists are kept in blocks of ``block`` authors. A commit whose files have at
    most ``in_row`` authors together unites the list prefixes in one row; for a larger one the
    authors are counted by joins (``_developers_by_join``).
    """
    rows = history.select("commit_id", "commit_date", "path", "file_authors")
    # commits above the limit are few and known to every task if Spark finds them small; the others need not move for it
    heavy = rows.groupBy("commit_id").agg(F.sum("file_authors").alias("_load")).filter(F.col("_load") > in_row)
    heavy = stored(heavy.select("commit_id"), "heavy")
    small = rows.filter(F.col("commit_id").isNotNull()).join(heavy, "commit_id", "left_anti")
    # lists beyond the limit are not needed here: nobody reads past in_row entries of a file
    lists = (
        places.filter(F.col("_nth") <= in_row)
        .groupBy("path", F.floor((F.col("_nth") - 1) / block).alias("_block"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "author"))), lambda e: e["author"]).alias("_authors"))
    )
    last = F.floor((F.col("file_authors") - 1) / block)
    wanted = small.select(
        "commit_id", "path", "file_authors", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block")
    )
    upto = F.least(F.col("file_authors") - F.col("_block") * block, F.lit(block)).cast("int")
    united = (
        wanted.join(lists, ["path", "_block"])
        .select("commit_id", F.slice("_authors", F.lit(1), upto).alias("_a"))
        .groupBy("commit_id")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("_a")))).cast("bigint").alias("ndev"))
    )
    large = rows.join(heavy, "commit_id", "left_semi")
    return united.unionByName(_developers_by_join(places.select("path", "author", "first"), large))


def _developers_by_join(first: DataFrame, rows: DataFrame) -> DataFrame:
    """The file with the most authors is counted by its running count alone. Only the other files of
    a commit list their authors, and those are added that the first file does not have yet. So the
    author list of a hot file is not repeated for each of its commits."""
    top = rows.groupBy("commit_id").agg(
        F.max_by(F.struct("path", "file_authors"), F.struct("file_authors", "path")).alias("top")
    )
    top = top.select("commit_id", F.col("top.path").alias("top_path"), F.col("top.file_authors").alias("n_top"))
    now = F.struct("commit_date", "commit_id")
    others = rows.join(top, "commit_id").filter(F.col("path") != F.col("top_path"))
    listed = (
        others.join(first, "path")
        .filter(F.col("first") <= now)
        .select("commit_id", "commit_date", "top_path", "author")
        .distinct()
    )
    in_top = first.select(F.col("path").alias("top_path"), "author", F.col("first").alias("top_first"))
    extra = (
        # one row per (file, author) on the built side, so its partitions are even
        listed.join(in_top.hint("shuffle_hash"), ["top_path", "author"], "left")
        .filter(F.col("top_first").isNull() | (F.col("top_first") > now))
        .groupBy("commit_id")
        .agg(F.count(F.lit(1)).alias("n_extra"))
    )
    return top.join(extra, "commit_id", "left").select(
        "commit_id", (F.col("n_top") + F.coalesce("n_extra", F.lit(0))).alias("ndev")
    )


def author_touches(changes: DataFrame) -> DataFrame:
    """File touches per commit; all files of a commit count together."""
    return changes.groupBy("author", "commit_id", "commit_date").agg(F.count(F.lit(1)).alias("touches"))


def experience(changes: DataFrame) -> DataFrame:
    """``exp``: file touches of the author so far."""
    return ordered_scan(stored(author_touches(changes), "touches"), ["author"], WHEN, {"exp": running_sum("touches")})


def recent_experience(touches: DataFrame) -> DataFrame:
    """``rexp``: touches of the author so far, each weighted 1 / (age in days + 1), ages exact to the fraction of a second.
    Input is that of `author_touches`."""
    out = decayed_sum(touches, ["author"], "commit_date", WHEN, F.col("touches"), "rexp")
    return out.select("commit_id", "rexp")


def subsystem_experience(changes: DataFrame) -> DataFrame:
    """``sexp``: distinct files the author has touched so far inside the touched subsystems."""
    return _subsystem_experience(own_touches(changes))


def _subsystem_experience(touches: DataFrame) -> DataFrame:
    """`subsystem_experience` of rows that have ``own_changes``. Nobody knows the files of an author without a name."""
    new = (F.col("own_changes") == 1) & F.col("author").isNotNull() & F.col("commit_id").isNotNull()
    sub = x.subsystem(F.col("path")).alias("sub")
    known = F.sum((new & F.col("sub").isNotNull()).cast("bigint")).alias("new_files")
    marked = touches.withColumn("sub", sub).groupBy("author", "sub", *WHEN).agg(known)
    run = ordered_scan(stored(marked, "subs"), ["author", "sub"], WHEN, {"_known": running_sum("new_files")})
    return run.groupBy("commit_id").agg(F.sum("_known").alias("sexp"))


def process_metrics(
    changes: DataFrame, fixes: DataFrame, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """The 14 metrics per commit. History is taken from all rows; the day range is cut afterwards.

    ``fixes`` has (commit_id, fix).
    """
    changes = stored(changes, "changes")  # read by every metric below
    touches = own_touches(changes.select("commit_id", "path", "author", "commit_date"))
    history = stored(_file_history(touches), "history")
    with_exp = stored(experience(changes), "experience")
    own = own_metrics(changes)
    if first_day is not None:
        own = own.filter(F.to_date("commit_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        own = own.filter(F.to_date("commit_date") <= F.lit(last_day).cast("date"))
    out = own.join(fixes, "commit_id", "left").withColumn("fix", F.coalesce("fix", F.lit(0)))
    for part in (
        stored(_developers(_new_authors(history), history), "developers"),
        changes_and_age(history),
        with_exp.select("commit_id", "exp"),
        stored(recent_experience(with_exp.drop("exp")), "rexp"),
        stored(_subsystem_experience(touches), "sexp"),
    ):
        out = out.join(part, "commit_id")
    return out


def history_features(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Strictly earlier changes, authors and own touches over the touched files, and the author's
    share of all commits so far."""
    changes = stored(changes.select("commit_id", "path", "author", "commit_date"), "changes")
    history = stored(_file_history(own_touches(changes)), "history")
    past = history.groupBy("commit_id").agg(
        F.sum(F.col("own_changes") - 1).alias("author_touches"), F.sum(F.col("file_changes") - 1).alias("past_changes")
    )
    commits = stored(commits.select("author", *WHEN), "commits")
    by_author = stored(ordered_scan(commits, ["author"], WHEN, {"_mine": row_number()}), "mine")
    share = ordered_scan(by_author, [], WHEN, {"_all": row_number()}).select(
        "commit_id", (F.col("_mine") / F.col("_all")).alias("author_share")
    )
    out = stored(_developers(_new_authors(history), history), "developers").join(past, "commit_id").join(share, "commit_id")
    # the author of the commit is new to these files when none of them has an earlier own touch
    newcomer = F.when(F.col("author_touches") == 0, 1).otherwise(0)
    return out.withColumn("past_authors", F.col("ndev") - newcomer).drop("ndev")


def first_files_and_lines(lines: DataFrame, max_files: int = 10, max_lines: int = 11) -> DataFrame:
    """The first files of each commit and the first lines of each side of them.

    Both limits are constants on a rank, so rows beyond them are dropped before the shuffle.
    """
    files = lines.select("commit_id", "path").distinct()
    by_commit = Window.partitionBy("commit_id").orderBy("path")
    kept = files.withColumn("_f", F.row_number().over(by_commit)).filter(F.col("_f") <= max_files).drop("_f")
    by_side = Window.partitionBy("commit_id", "path", "side").orderBy("line_no")
    top = lines.withColumn("_l", F.row_number().over(by_side)).filter(F.col("_l") <= max_lines).drop("_l")
    return top.join(kept, ["commit_id", "path"], "left_semi")


def commit_caps(
    changes: DataFrame, parents: DataFrame, max_files: int = 200, max_deleted: int = 10_000, max_changed: int = 2_000
) -> DataFrame:
    """Commits within the size limits that are no merges (at most one parent)."""
    sizes = changes.groupBy("commit_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.max("lines_deleted").alias("most_deleted"),
        F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("changed"),
    )
    fits = sizes.filter(
        (F.col("files") < max_files) & (F.col("most_deleted") <= max_deleted) & (F.col("changed") <= max_changed)
    )
    merges = parents.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return fits.join(merges, "commit_id", "left_anti")


def modified_only(files: DataFrame, max_files: int = 200) -> DataFrame:
    """Modified files (type M) of commits that do not modify too many of them."""
    modified = files.filter(F.col("change_type") == "M")
    small = modified.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_files)
    return modified.join(small.select("commit_id"), "commit_id", "left_semi")
