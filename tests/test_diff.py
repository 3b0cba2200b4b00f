"""Diff and blame text: new, deleted, renamed, binary and mode-only files, empty sides, missing counts."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import diff as d

DIFF = """commit header line
diff --git a/src/a.c b/src/a.c
index 1..2 100644
--- a/src/a.c
+++ b/src/a.c
@@ -3,2 +3,3 @@ int f()
 ctx
--- looks like a header
+++ also one
+more
@@ -10 +12,0 @@
-gone
\\ No newline at end of file
diff --git a/new.c b/new.c
new file mode 100644
--- /dev/null
+++ b/new.c
@@ -0,0 +1 @@
+first
diff --git a/old name.c b/new name.c
similarity index 100%
rename from old name.c
rename to new name.c
diff --git a/x.bin b/x.bin
Binary files a/x.bin and b/x.bin differ
diff --git a/run.sh b/run.sh
old mode 100644
new mode 100755
diff --git a/gone.c b/gone.c
deleted file mode 100644
--- a/gone.c
+++ /dev/null
@@ -1,2 +0,0 @@
-one
-two"""


@pytest.fixture(scope="module")
def text(spark):
    return spark.createDataFrame([(7, DIFF)], "commit_id int, diff_text string")


def test_lines(text, rows):
    got = rows(d.diff_lines(text), "file_no", "hunk_no", "side", "line_a", "line_b", "code")
    assert got == sorted(
        [
            (1, 1, "ab", 3, 3, "ctx"),
            (1, 1, "a", 4, None, "-- looks like a header"),
            (1, 1, "b", None, 4, "++ also one"),
            (1, 1, "b", None, 5, "more"),
            (1, 2, "a", 10, None, "gone"),
            (2, 1, "b", None, 1, "first"),
            (6, 1, "a", 1, None, "one"),
            (6, 1, "a", 2, None, "two"),
        ],
        key=repr,
    )


def test_files(text):
    f = {r["file_no"]: r for r in d.diff_files(text).collect()}
    assert len(f) == 6
    assert f[2]["is_new"] and f[3]["is_renamed"] and f[4]["is_binary"] and f[6]["is_deleted"]
    assert (f[3]["file_a"], f[3]["file_b"]) == ("old name.c", "new name.c")
    assert (f[5]["old_mode"], f[5]["new_mode"]) == ("100644", "100755")
    assert (f[1]["removed"], f[1]["added"]) == (2, 2)
    assert sorted(r["file_b"] for r in d.skip_files(d.diff_files(text)).collect()) == ["gone.c", "run.sh", "src/a.c"]


def test_hunk_header_sides(spark):
    df = spark.createDataFrame([("@@ -5,0 +6 @@ x",)], "h string").select(*[c.alias(n) for n, c in d.hunk_numbers("h").items()])
    r = df.first()
    assert (r["old_start"], r["old_end"]) == (None, None)
    assert (r["new_start"], r["new_count"], r["new_end"]) == (6, 1, 6)


def test_blame_ranges(spark, rows):
    text = "\n".join(
        [
            "abc1 1 (Jo van Do 1500000000 +0200 1) int a;",
            "abc1 f name.c 2 (Jo van Do 1500000000 +0200 2) int b;",
            "def2 f.c 9 (Al 1400000000 -0100 3) }",
            "abc1 f.c 4 (Jo van Do 1500000000 +0200 4) x",
        ]
    )
    lines = d.blame_lines(spark.createDataFrame([(1, text)], "commit_id int, blame_text string"))
    assert lines.filter("blame_commit = 'def2'").select("line_a", "author", "time", "line_b").first() == (9, "Al", 1400000000, 3)
    got = rows(d.contiguous_ranges(lines, ["blame_commit"], "line_b"), "blame_commit", "start", "end")
    assert got == [("abc1", 1, 2), ("abc1", 4, 4), ("def2", 3, 3)]


def mask_by_loop(lines):
    out, inside = [], False
    for line in lines:
        s = line.strip()
        hit = s == "" or s.startswith("//")
        code = not (inside or s.startswith("/*"))
        for i in range(len(s) - 1):
            pair = s[i : i + 2]
            if pair == "/*":
                inside = True
            if pair == "*/":
                inside = False
                if i != len(s) - 2:
                    code = True
        out.append(hit or not code)
    return out


@pytest.mark.parametrize(
    "lines",
    [
        ["int a;", "/* one", "two", "three */", "b();", "", "// x", "c(); /* tail", "in */ d();", "/* a */ e();", "/*/", "f", "*/"],
        ["a /* b */ c /* d", "e", "*/ f */", "g"],
    ],
)
def test_comment_mask(spark, lines):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "f int, n int, code string")
    got = [r["masked"] for r in d.comment_mask(df, ["f"], "n", "code").orderBy("n").collect()]
    assert got == mask_by_loop(lines)


def test_merge_hunks(spark):
    cols = "commit_id int, path string, pre_start int, pre_end int, post_start int, post_end int, pre string, post string"
    rows = [
        (1, "a", 1, 2, 1, 3, "x", "y"),
        (1, "a", 9, 9, 8, 8, "x", "y"),  # the same change
        (1, "a", 20, 21, None, None, "x", None),  # joins the first with pre x
        (1, "a", None, None, 30, 31, None, "z"),  # nobody has post z
        (1, "a", None, None, None, None, None, None),  # follows the earliest one-sided hunk
        (1, "a", 40, 41, 40, 41, "x", "w"),
        (1, "b", 1, 1, 1, 1, "x", "y"),  # another file
    ]
    got = {(r["path"], r["pre"], r["post"]): r for r in d.merge_hunks(spark.createDataFrame(rows, cols)).collect()}
    # the empty hunk has no range, so the first one-sided hunk in order is the one at 20, which joined (x, y)
    first = got[("a", "x", "y")]
    assert (first["pre_start"], first["pre_end"], first["post_start"], first["post_end"]) == (1, 21, 1, 8)
    assert first["n_hunks"] == 4
    assert got[("a", None, "z")]["n_hunks"] == 1 and got[("a", "x", "w")]["n_hunks"] == 1
    assert got[("b", "x", "y")]["n_hunks"] == 1 and len(got) == 4


def test_range_text(spark):
    df = spark.createDataFrame([("1-3|None-None", "2-9|4-5")], "a string, b string")
    assert df.select(d.merged_range(F.col("a"), F.col("b"))).first()[0] == "1-9|4-5"


def test_context_prefers_functions(spark):
    lines = ["#include", "", "/* doc", " * more", " */", "int f() {", "  a();", "}", "", "tail1", "tail2"]
    files = spark.createDataFrame([(1, lines)], "id int, lines array<string>")
    extents = spark.createDataFrame([(1, 6, 8)], "id int, start_line int, end_line int")
    changed = spark.createDataFrame([(1, 7), (1, 9), (1, 11)], "id int, line_no int")
    r = d.context_snippets(changed, files, extents, "id", around=1).first()
    # the comment block above the function belongs to it; a blank line alone brings no context
    assert r["covered"] == [1, 2, 3, 4, 5, 6, 7, 8, 10, 11]
