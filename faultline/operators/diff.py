"""Unified diffs, blame text, hunks and line ranges as rows.

A text column is exploded into lines; windows over the lines of one text carry the file, hunk and
line numbers forward. Such a window never spans more than one input text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators.intervals import points_in_intervals

# The headers of unified diffs.
FILE_HEADER = r"^diff --git a/(.*?)\s* b/(.*?)\s*$"
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"
BLAME_LINE = r"^(\S+)\s+(?:.*?\s)??(\d+)\s+\((.*?)\s+(\d+)\s+([+-]\d{4})\s+(\d+)\)"
# Marks of comment code, and words and calls that make a line worth blaming.
COMMENT_MARK = r"#|//|/\*|\*/"
LINE_KEYWORDS = ("if", "else", "goto", "return", "sizeof", "break", "NULL")
JAVA_LINE_KEYWORDS = ("if", "else", "return", "break", "null")
CALL = r"[a-zA-Z_][a-zA-Z_0-9$]*\(.*?\)"


def _tagged_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with the number of their file and of their hunk inside the file (0: header lines)."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    is_file, is_hunk = F.startswith("line", F.lit("diff --git ")), F.col("line").rlike(HUNK_HEADER)
    whole = Window.partitionBy(key).orderBy("pos")
    tagged = lines.withColumn("file_no", F.sum(is_file.cast("int")).over(whole)).filter("file_no > 0")
    in_file = Window.partitionBy(key, "file_no").orderBy("pos")
    return tagged.withColumn("is_hunk", is_hunk).withColumn("hunk_no", F.sum(F.col("is_hunk").cast("int")).over(in_file))


def _group(col: str, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, i), F.lit(""))


def hunk_numbers(header: Column | str) -> dict[str, Column]:
    """Start, count and end of both sides of a hunk header. A missing count is 1; a count of 0 means
    the side is empty: start and end are null."""
    h = F.col(header) if isinstance(header, str) else header
    part = lambda i: F.nullif(F.regexp_extract(h, HUNK_HEADER, i), F.lit(""))
    out = {}
    for side, s, c in (("old", 1, 2), ("new", 3, 4)):
        start = part(s).cast("int")
        count = F.coalesce(part(c).cast("int"), F.lit(1))
        out[f"{side}_start"] = F.when(count > 0, start)
        out[f"{side}_count"] = count
        out[f"{side}_end"] = F.when(count > 0, start + count - 1)
    return out


def diff_lines(df: DataFrame, key: str = "commit_id", text: str = "diff_text") -> DataFrame:
    """One row per body line: file names, hunk, side (``a`` removed, ``b`` added, ``ab`` context),
    line numbers on both sides and the code."""
    tagged = _tagged_lines(df, key, text)
    in_file = Window.partitionBy(key, "file_no").orderBy("pos")
    header = F.when(F.startswith("line", F.lit("diff --git ")), F.col("line"))
    tagged = tagged.withColumn("_fh", F.last(header, ignorenulls=True).over(in_file))
    in_hunk = Window.partitionBy(key, "file_no", "hunk_no").orderBy("pos")
    mark = F.substring("line", 1, 1)
    body = (F.col("hunk_no") > 0) & ~F.col("is_hunk")
    old_step = (body & mark.isin(" ", "-")).cast("int")
    new_step = (body & mark.isin(" ", "+")).cast("int")
    numbers = hunk_numbers("_hh")
    placed = (
        tagged.withColumn("_hh", F.first(F.when(F.col("is_hunk"), F.col("line")), ignorenulls=True).over(in_hunk))
        .withColumn("_old", F.sum(old_step).over(in_hunk))
        .withColumn("_new", F.sum(new_step).over(in_hunk))
        .filter(body & mark.isin(" ", "-", "+"))
    )
    side = F.when(mark == "-", "a").when(mark == "+", "b").otherwise("ab")
    return placed.select(
        key,
        "file_no",
        _group("_fh", FILE_HEADER, 1).alias("file_a"),
        _group("_fh", FILE_HEADER, 2).alias("file_b"),
        "hunk_no",
        side.alias("side"),
        F.when(mark != "+", numbers["old_start"] + F.col("_old") - 1).cast("bigint").alias("line_a"),
        F.when(mark != "-", numbers["new_start"] + F.col("_new") - 1).cast("bigint").alias("line_b"),
        F.substring(F.col("line"), 2, 2**31 - 1).alias("code"),
    )


def diff_files(df: DataFrame, key: str = "commit_id", text: str = "diff_text") -> DataFrame:
    """One row per file of a diff: names, flags, modes and line counts."""
    tagged = _tagged_lines(df, key, text)
    head = F.col("hunk_no") == 0
    body = (F.col("hunk_no") > 0) & ~F.col("is_hunk")
    mark = F.substring("line", 1, 1)

    def found(pattern: str) -> Column:
        return F.bool_or(head & F.col("line").rlike(pattern))

    def value(pattern: str) -> Column:
        return F.max(F.when(head, _group("line", pattern, 1)))

    return tagged.groupBy(key, "file_no").agg(
        F.max(_group("line", FILE_HEADER, 1)).alias("file_a"),
        F.max(_group("line", FILE_HEADER, 2)).alias("file_b"),
        found("^new file mode ").alias("is_new"),
        found("^deleted file mode ").alias("is_deleted"),
        found("^rename (from|to) ").alias("is_renamed"),
        found("^Binary files .* differ$").alias("is_binary"),
        value(r"^old mode (\d+)$").alias("old_mode"),
        value(r"^new mode (\d+)$").alias("new_mode"),
        F.count_if(body & (mark == "-")).alias("removed"),
        F.count_if(body & (mark == "+")).alias("added"),
    )


def skip_files(files: DataFrame) -> DataFrame:
    """Drop files that are only added, only renamed or binary."""
    pure_rename = F.col("is_renamed") & (F.col("removed") + F.col("added") == 0)
    return files.filter(~(F.col("is_new") | pure_rename | F.col("is_binary")))


def classified_code(line: Column) -> tuple[Column, Column]:
    """Side and code of a bare diff line; the mark goes, and one tab right behind it."""
    side = F.when(line == "---", None).when(F.startswith(line, F.lit("+")), "added").when(
        F.startswith(line, F.lit("-")), "removed"
    )
    return side, F.regexp_replace(line, r"^[+-]\t?", "")


def blame_lines(df: DataFrame, key: str = "commit_id", text: str = "blame_text") -> DataFrame:
    """One row per blamed line: origin commit, author, time, line there and line here."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("line"))
    part = lambda i: F.regexp_extract("line", BLAME_LINE, i)
    return lines.filter(F.col("line").rlike(BLAME_LINE)).select(
        key,
        part(1).alias("blame_commit"),
        part(2).cast("bigint").alias("line_a"),
        part(3).alias("author"),
        part(4).cast("bigint").alias("time"),
        part(6).cast("bigint").alias("line_b"),
    )


def contiguous_ranges(lines: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Runs of consecutive line numbers per key: ``(keys, start, end)``."""
    w = Window.partitionBy(*keys).orderBy(line)
    island = lines.withColumn("_island", F.col(line) - F.row_number().over(w))
    return island.groupBy(*keys, "_island").agg(
        F.min(line).alias("start"), F.max(line).alias("end")
    ).drop("_island")


def comment_mask(lines: DataFrame, keys: Sequence[str], line_no: str, code: str) -> DataFrame:
    """Adds ``masked``: the line is blank, a line comment, or inside a block comment.

    The state after a line is set by the last block mark on it; lines without a mark keep the state
    before. So the state is the latest mark seen, carried forward over the lines of the file.
    """
    s = F.trim(F.regexp_replace(code, r"\s+", " "))
    backwards = F.reverse(s)
    last_open, last_close = F.instr(backwards, "*/"), F.instr(backwards, "/*")
    after = F.when((last_open > 0) & ((last_close == 0) | (last_open < last_close)), True).when(
        last_close > 0, False
    )
    before = Window.partitionBy(*keys).orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    state = lines.withColumn("_s", s).withColumn("_after", after)
    state = state.withColumn("_in", F.coalesce(F.last("_after", ignorenulls=True).over(before), F.lit(False)))
    s = F.col("_s")
    closes_inside = F.contains(F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0))), F.lit("*/"))
    has_code = ~(F.col("_in") | F.startswith(s, F.lit("/*"))) | closes_inside
    blank = (s == "") | F.startswith(s, F.lit("//"))
    return state.withColumn("masked", blank | ~has_code).drop("_s", "_after", "_in")


def worth_blaming(code: Column, keywords: Sequence[str] = LINE_KEYWORDS) -> Column:
    """The line holds a keyword or a call."""
    return code.rlike("|".join(keywords)) | code.rlike(CALL)


def overlapping(lines: DataFrame, extents: DataFrame, keys: Sequence[str], line: str = "line_no") -> DataFrame:
    """Changed lines with the functions around them; a line meets only functions that hold it."""
    return points_in_intervals(lines, extents, keys, line, "start_line", "end_line")


def blamed(lines: DataFrame, blame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Removed lines with the commit that wrote them; line -1 and empty text where unknown."""
    found = lines.join(blame.select(*keys, "line_a", "blame_commit"), list(keys), "left")
    return found.withColumn("line_a", F.coalesce("line_a", F.lit(-1).cast("bigint"))).withColumn(
        "blame_commit", F.coalesce(F.col("blame_commit").cast("string"), F.lit(""))
    )


def parse_range(text: Column) -> dict[str, Column]:
    """``a-b|c-d`` (``None`` for a missing number) to four numbers."""
    sides = F.split(text, r"\|")
    out = {}
    for i, side in enumerate(("pre", "post")):
        ends = F.split(sides[i], "-")
        for j, end in enumerate(("start", "end")):
            out[f"{side}_{end}"] = F.nullif(ends[j], F.lit("None")).cast("int")
    return out


def range_text(pre_start: Column, pre_end: Column, post_start: Column, post_end: Column) -> Column:
    t = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(t(pre_start), F.lit("-"), t(pre_end), F.lit("|"), t(post_start), F.lit("-"), t(post_end))


def merged_range(a: Column, b: Column) -> Column:
    """Smallest range around both; a missing number gives way to the other one."""
    x, y = parse_range(a), parse_range(b)
    return range_text(
        F.least(x["pre_start"], y["pre_start"]),
        F.greatest(x["pre_end"], y["pre_end"]),
        F.least(x["post_start"], y["post_start"]),
        F.greatest(x["post_end"], y["post_end"]),
    )


RANGE = ("pre_start", "pre_end", "post_start", "post_end")


def merge_hunks(hunks: DataFrame, keys: Sequence[str] = ("commit_id", "path")) -> DataFrame:
    """Merge hunks of a file that hold the same change.

    Hunks with equal ``pre`` and ``post`` are one. A hunk without one side joins the earliest hunk
    that has both sides and agrees on the side it has; an empty hunk joins the earliest one-sided
    hunk. The order is that of the line ranges. Every step groups or joins on content keys, so no
    pair of hunks is compared.
    """
    keys = list(keys)
    order = F.struct(F.coalesce("pre_start", "post_start").alias("o"), *RANGE)
    ends = [F.min("pre_start"), F.max("pre_end"), F.min("post_start"), F.max("post_end")]
    same = hunks.groupBy(*keys, "pre", "post").agg(
        *[e.alias(n) for e, n in zip(ends, RANGE)], F.min(order).alias("_first"), F.count(F.lit(1)).alias("n_hunks")
    )
    full = same.filter(F.col("pre").isNotNull() & F.col("post").isNotNull())
    pick = lambda side: F.min_by(F.struct("pre", "post"), F.struct("_first", "pre", "post")).alias(f"_by_{side}")
    by_pre = full.groupBy(*keys, "pre").agg(pick("pre"))
    by_post = full.groupBy(*keys, "post").agg(pick("post"))
    one_sided = same.filter(F.col("pre").isNull() != F.col("post").isNull())
    lonely = one_sided.groupBy(*keys).agg(
        F.min_by(F.struct("pre", "post"), F.struct("_first", "pre", "post")).alias("_by_any")
    )
    own = F.struct("pre", "post")
    joined = (
        same.join(by_pre, [*keys, "pre"], "left")
        .join(by_post, [*keys, "post"], "left")
        .join(lonely, keys, "left")
    )
    both, neither = F.col("pre").isNotNull() & F.col("post").isNotNull(), F.col("pre").isNull() & F.col("post").isNull()
    step1 = (
        F.when(both, own)
        .when(neither, F.coalesce("_by_any", own))
        .when(F.col("pre").isNotNull(), F.coalesce("_by_pre", own))
        .otherwise(F.coalesce("_by_post", own))
    )
    placed = joined.withColumn("_to", step1).drop("_by_pre", "_by_post", "_by_any")
    # an empty hunk follows its one-sided hunk one step further
    onward = placed.filter(F.col("pre").isNull() != F.col("post").isNull()).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.struct("pre", "post").alias("_from"), F.col("_to").alias("_next")
    )
    meets = F.col("_to").eqNullSafe(F.col("_from"))
    for k in keys:
        meets = meets & (F.col(k) == F.col(f"_k_{k}"))
    final = placed.join(onward, meets, "left").select(
        *keys, F.coalesce("_next", "_to").alias("_t"), *RANGE, "n_hunks"
    )
    return final.groupBy(*keys, F.col("_t.pre").alias("pre"), F.col("_t.post").alias("post")).agg(
        *[e.alias(n) for e, n in zip(ends, RANGE)], F.sum("n_hunks").alias("n_hunks")
    )


def context_snippets(changed: DataFrame, files: DataFrame, extents: DataFrame, key: str, around: int = 3) -> DataFrame:
    """Code around changed lines: the enclosing function with the comment block above it, else the
    line with ``around`` lines on both sides (not for a blank line). Contexts of one key are laid
    over each other, so each code line appears once.

    ``changed`` (key, line_no), ``files`` (key, lines array), ``extents`` (key, start_line, end_line).
    """
    inside = overlapping(changed, extents, [key]).select(key, "line_no", "start_line", "end_line")
    bare = changed.join(inside.select(key, "line_no").distinct(), [key, "line_no"], "left_anti")
    spans = inside.select(key, "line_no", "start_line", "end_line").unionByName(
        bare.select(key, "line_no", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    )
    with_lines = spans.join(files, key)
    n = F.size("lines")
    comment = lambda s: (F.trim(s) == "") | F.trim(s).rlike(r"^(\*|/\*|#)")
    above = F.slice(F.col("lines"), F.lit(1), F.greatest(F.col("start_line") - 1, F.lit(0)))
    run = F.aggregate(above, F.lit(0), lambda a, s: F.when(comment(s), a + 1).otherwise(0))
    start = F.when(F.col("start_line").isNotNull(), F.col("start_line") - run).otherwise(
        F.greatest(F.col("line_no") - around, F.lit(1))
    )
    end = F.when(F.col("end_line").isNotNull(), F.least(F.col("end_line"), n)).otherwise(
        F.least(F.col("line_no") + around, n)
    )
    usable = F.col("start_line").isNotNull() | (F.trim(F.element_at("lines", F.col("line_no").cast("int"))) != "")
    covered = (
        with_lines.filter(F.col("line_no").between(1, n))
        .filter(usable)
        .select(key, F.explode(F.sequence(start.cast("int"), end.cast("int"))).alias("_i"))
        .distinct()
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("_i")).alias("covered"))
    )
    return covered.join(files, key).select(
        key, "covered", F.array_join(F.transform("covered", lambda i: F.element_at(F.col("lines"), i)), "\n").alias("snippet")
    )
