"""Diff, blame and hunk operators on rows and texts derived from the supplied tables."""

from pyspark.sql import functions as F

from faultline.functions import text as x
from faultline.functions.columns import big
from faultline.operators import diff as df_
from faultline.plans.registry import VIEWS, query

_MARKS = ("' '", "'-'", "'+'")


def _diff_texts(t):
    """A diff per document: its lines as context, removed and added in turn, in two hunks, then an
    entry for a binary file. Some are marked new, some renamed."""
    lines = F.split("text", "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    marked = F.transform(lines, lambda s, i: F.concat(F.when(i % 3 == 0, " ").when(i % 3 == 1, "-").otherwise("+"), s))

    def hunk(part, old0, new0):
        old = F.size(F.filter(part, lambda s: ~F.startswith(s, F.lit("+"))))
        new = F.size(F.filter(part, lambda s: ~F.startswith(s, F.lit("-"))))
        head = F.format_string("@@ -%d,%d +%d,%d @@ f()", old0, old, new0, new)
        return F.when(F.size(part) > 0, F.concat(head, F.lit("\n"), F.array_join(part, "\n"), F.lit("\n"))).otherwise("")

    first = F.slice(marked, F.lit(1), half)
    second = F.slice(marked, half + 1, F.size(marked))
    name = F.format_string("src/d%d.c", "doc_id")
    head = F.concat(
        F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("new file mode 100644\n")).otherwise(""),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("rename from "), name, F.lit("\nrename to "), name, F.lit("\n"))).otherwise(""),
        F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"),
    )
    tail = F.lit("diff --git a/x.bin b/x.bin\nindex 12..34 100644\nBinary files a/x.bin and b/x.bin differ")
    text = F.concat(head, hunk(first, F.lit(1), F.lit(1)), hunk(second, F.lit(10_001), F.lit(20_001)), tail)
    return t.documents.select(F.col("doc_id").alias("commit_id"), text.alias("diff_text"))


VIEWS["o_doc_lines"] = """
SELECT doc_id, i, line, n, i < floor(n / 2) AS first_half, i % 3 AS m FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i,
         len(string_split(text, chr(10))) AS n FROM documents)"""


@query(
    "q_diff_lines",
    """SELECT doc_id AS commit_id, 'src/d' || doc_id || '.c' AS file_a, CASE WHEN first_half OR n = 1 THEN 1 ELSE 2 END AS hunk_no,
    CASE m WHEN 0 THEN 'ab' WHEN 1 THEN 'a' ELSE 'b' END AS side,
    CASE WHEN m <> 2 THEN CAST(CASE WHEN first_half THEN 0 ELSE 10000 END + sum(CASE WHEN m <> 2 THEN 1 ELSE 0 END) OVER w AS BIGINT) END AS line_a,
    CASE WHEN m <> 1 THEN CAST(CASE WHEN first_half THEN 0 ELSE 20000 END + sum(CASE WHEN m <> 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) END AS line_b,
    line AS code FROM {o_doc_lines} WINDOW w AS (PARTITION BY doc_id, first_half ORDER BY i)""",
)
def q_diff_lines(t):
    rows = df_.diff_lines(_diff_texts(t))
    return rows.select("commit_id", "file_a", F.col("hunk_no").cast("int").alias("hunk_no"), "side", "line_a", "line_b", "code")


@query(
    "q_skip_files",
    """SELECT doc_id AS commit_id, 'src/d' || doc_id || '.c' AS file_b, count(*) FILTER (m = 1) AS removed, count(*) FILTER (m = 2) AS added
    FROM {o_doc_lines} WHERE doc_id % 7 <> 0 GROUP BY doc_id HAVING NOT (doc_id % 5 = 0 AND count(*) FILTER (m <> 0) = 0)""",
)
def q_skip_files(t):
    return df_.skip_files(df_.diff_files(_diff_texts(t))).select("commit_id", "file_b", "removed", "added")


VIEWS["v_hunk_headers"] = """
SELECT l_orderkey AS commit_id, l_partkey AS partkey, l_linenumber AS nr, l_suppkey AS suppkey,
       concat('@@ -', CAST(l_linenumber AS VARCHAR(20)),
              CASE WHEN l_tax < 0.02 THEN '' ELSE concat(',', CAST(CAST(round(l_tax * 100) AS INT) % 5 AS VARCHAR(20))) END,
              ' +', CAST(l_linenumber + 3 AS VARCHAR(20)),
              CASE WHEN l_discount < 0.02 THEN '' ELSE concat(',', CAST(CAST(round(l_discount * 100) AS INT) % 4 AS VARCHAR(20))) END,
              ' @@ int f(int a)') AS header,
       CASE WHEN l_tax < 0.02 THEN 1 ELSE CAST(round(l_tax * 100) AS INT) % 5 END AS oc,
       CASE WHEN l_discount < 0.02 THEN 1 ELSE CAST(round(l_discount * 100) AS INT) % 4 END AS nc
FROM {lineitem}"""


@query(
    "q_hunk_header",
    """SELECT commit_id, partkey, suppkey, nr, CASE WHEN oc > 0 THEN nr END AS old_start, oc AS old_count,
    CASE WHEN oc > 0 THEN nr + oc - 1 END AS old_end, CASE WHEN nc > 0 THEN nr + 3 END AS new_start, nc AS new_count,
    CASE WHEN nc > 0 THEN nr + 3 + nc - 1 END AS new_end FROM {v_hunk_headers}""",
)
def q_hunk_header(t):
    cols = [c.alias(n) for n, c in df_.hunk_numbers("header").items()]
    return t.v_hunk_headers.select("commit_id", "partkey", "suppkey", "nr", *cols)


def _blame_texts(t):
    """Blame output over a document's lines; every three lines share an origin commit, two origins alternate."""
    def line(s, i):
        origin = F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), (F.floor(i / 3) % 2).cast("string"))), 1, 12)
        return F.format_string(
            "%s src/a b.c %d (Ada Lin %s %d +0000 %d) %s", origin, i + 1, F.col("lang"), F.col("doc_id") + 1000, i + 1, s
        )

    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return t.documents.select(F.col("doc_id").alias("commit_id"), text.alias("blame_text"))


@query(
    "q_line_ranges",
    """WITH b AS (SELECT doc_id, lang, substr(md5(doc_id || ':' || CAST(floor(i / 3) % 2 AS INT)), 1, 12) AS sha, i + 1 AS line
      FROM {o_doc_lines} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
    g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, sha ORDER BY line) AS island FROM b)
    SELECT doc_id AS commit_id, sha AS blame_commit, 'Ada Lin ' || lang AS author, doc_id + 1000 AS time,
    CAST(min(line) AS BIGINT) AS "start", CAST(max(line) AS BIGINT) AS "end" FROM g GROUP BY doc_id, sha, lang, island""",
)
def q_line_ranges(t):
    rows = df_.blame_lines(_blame_texts(t))
    return df_.contiguous_ranges(rows, ["commit_id", "blame_commit", "author", "time"], "line_b")


VIEWS["v_code_lines"] = """
SELECT l.l_orderkey AS commit_id, l.l_linenumber AS line_no,
       max(CASE CAST(floor(l.l_quantity) AS INT) % 7 WHEN 0 THEN '' WHEN 1 THEN concat('/* ', p.p_name) WHEN 2 THEN concat(p.p_name, ' */')
           WHEN 3 THEN concat(p.p_name, ' */ x(1);') WHEN 4 THEN concat('  // ', p.p_name) WHEN 5 THEN concat('if (a) /* ', p.p_name, ' */ return;')
           ELSE concat('int ', p.p_name, ';') END) AS code
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey, l.l_linenumber"""

VIEWS["o_mask"] = """
SELECT commit_id, line_no, code, s, (s = '' OR starts_with(s, '//'))
  OR NOT (NOT (coalesce(state0, FALSE) OR starts_with(s, '/*')) OR contains(s[1:length(s) - 1], '*/')) AS masked
FROM (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY commit_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state0
  FROM (SELECT commit_id, line_no, code, trim(code) AS s,
        CASE WHEN regexp_matches(code, '/\\*') AND NOT contains(regexp_extract(code, '.*/\\*(.*)$', 1), '*/') THEN TRUE
             WHEN contains(code, '*/') THEN FALSE END AS state FROM {v_code_lines}))"""


@query("q_comment_mask", "SELECT commit_id, line_no, masked FROM {o_mask}")
def q_comment_mask(t):
    return df_.comment_mask(t.v_code_lines, ["commit_id"], "line_no", "code").select("commit_id", "line_no", "masked")


@query(
    "q_keyword_line",
    """SELECT commit_id, line_no, regexp_matches(code, 'if|else|goto|return|sizeof|break|NULL')
    OR regexp_matches(code, '[a-zA-Z_][a-zA-Z_0-9$]*\\(.*?\\)') AS worth FROM {v_code_lines}""",
)
def q_keyword_line(t):
    return t.v_code_lines.select("commit_id", "line_no", df_.worth_blaming(F.col("code")).alias("worth"))


@query(
    "q_code_file_filter",
    """SELECT commit_id, path FROM {v_file_changes} WHERE regexp_matches(path, '\\.(c|c\\+\\+|cpp|h|hpp|cc)$') AND NOT contains(lower(path), 'test')""",
)
def q_code_file_filter(t):
    return t.v_file_changes.filter(x.is_code_file(F.col("path"))).select("commit_id", "path")


VIEWS["v_extents"] = """
SELECT l_orderkey AS commit_id, l_linenumber AS start_line, CAST(l_linenumber + floor(l_quantity / 10) AS INT) AS end_line,
       concat('fn_', CAST(l_partkey AS VARCHAR(20)), '_', CAST(l_suppkey AS VARCHAR(20))) AS function
FROM {lineitem}"""


@query(
    "q_interval_overlap",
    """SELECT c.commit_id, c.line_no, e.function, e.start_line, e.end_line FROM {v_code_lines} c JOIN {v_extents} e
    ON c.commit_id = e.commit_id AND c.line_no BETWEEN e.start_line AND e.end_line""",
)
def q_interval_overlap(t):
    rows = t.v_code_lines.select("commit_id", "line_no")
    out = df_.overlapping(rows, t.v_extents, ["commit_id"])
    return out.select("commit_id", "line_no", "function", "start_line", "end_line")


VIEWS["v_blame_known"] = """
SELECT commit_id, path, line_no, line_no + 10 AS line_a, commit_id - 1 AS blame_commit FROM {v_lines} WHERE side = 'del' AND line_no <= 5"""


@query(
    "q_line_blame",
    """SELECT l.commit_id, l.path, l.line_no, coalesce(b.line_a, -1) AS line_a, coalesce(CAST(b.blame_commit AS VARCHAR), '') AS blame_commit
    FROM {v_lines} l LEFT JOIN {v_blame_known} b ON l.commit_id = b.commit_id AND l.path = b.path AND l.line_no = b.line_no WHERE l.side = 'del'""",
)
def q_line_blame(t):
    removed = t.v_lines.filter("side = 'del'").select("commit_id", "path", "line_no")
    return df_.blamed(removed, t.v_blame_known, ["commit_id", "path", "line_no"])


VIEWS["v_range_pairs"] = """
SELECT l_orderkey AS commit_id, l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS nr,
       concat(CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_linenumber + 2 AS VARCHAR(20)), '|', CASE WHEN l_tax < 0.03 THEN 'None-None' ELSE concat(CAST(l_linenumber + 1 AS VARCHAR(20)), '-', CAST(l_linenumber + 4 AS VARCHAR(20))) END) AS a,
       concat(CASE WHEN l_discount < 0.03 THEN 'None-None' ELSE '4-9' END, '|', CASE WHEN l_tax < 0.05 THEN 'None-None' ELSE '2-6' END) AS b
FROM {lineitem}"""


@query(
    "q_range_merge",
    """WITH p AS (SELECT *, try_cast(split_part(split_part(a, '|', 1), '-', 1) AS INT) AS a1, try_cast(split_part(split_part(a, '|', 1), '-', 2) AS INT) AS a2,
      try_cast(split_part(split_part(a, '|', 2), '-', 1) AS INT) AS a3, try_cast(split_part(split_part(a, '|', 2), '-', 2) AS INT) AS a4,
      try_cast(split_part(split_part(b, '|', 1), '-', 1) AS INT) AS b1, try_cast(split_part(split_part(b, '|', 1), '-', 2) AS INT) AS b2,
      try_cast(split_part(split_part(b, '|', 2), '-', 1) AS INT) AS b3, try_cast(split_part(split_part(b, '|', 2), '-', 2) AS INT) AS b4 FROM {v_range_pairs})
    SELECT commit_id, partkey, suppkey, nr, coalesce(CAST(least(a1, b1) AS VARCHAR), 'None') || '-' || coalesce(CAST(greatest(a2, b2) AS VARCHAR), 'None') || '|'
    || coalesce(CAST(least(a3, b3) AS VARCHAR), 'None') || '-' || coalesce(CAST(greatest(a4, b4) AS VARCHAR), 'None') AS merged FROM p""",
)
def q_range_merge(t):
    return t.v_range_pairs.select(
        "commit_id", "partkey", "suppkey", "nr", df_.merged_range(F.col("a"), F.col("b")).alias("merged")
    )


VIEWS["v_hunks"] = """
SELECT l.l_orderkey AS commit_id, 'f.c' AS path, 10 * l.l_linenumber AS pre_start, 10 * l.l_linenumber + max(CAST(floor(l.l_quantity / 8) AS INT)) AS pre_end,
       12 * l.l_linenumber AS post_start, 12 * l.l_linenumber + max(CAST(floor(l.l_quantity / 6) AS INT)) AS post_end,
       CASE WHEN min(l.l_tax) < 0.03 THEN NULL ELSE substr(min(p.p_name), 1, 1) END AS pre,
       CASE WHEN min(l.l_discount) < 0.04 THEN NULL ELSE substr(min(p.p_type), 1, 1) END AS post
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey, l.l_linenumber"""


@query(
    "q_merge_hunks",
    """WITH s AS (SELECT commit_id, path, pre, post, min(pre_start) AS pre_start, max(pre_end) AS pre_end, min(post_start) AS post_start,
      max(post_end) AS post_end, count(*) AS n_hunks FROM {v_hunks} GROUP BY 1, 2, 3, 4),
    h AS (SELECT a.*, CASE WHEN a.pre IS NOT NULL AND a.post IS NULL THEN (SELECT arg_min(f.post, f.pre_start) FROM s f WHERE f.commit_id = a.commit_id AND f.pre = a.pre AND f.post IS NOT NULL) ELSE a.post END AS tpost,
      CASE WHEN a.pre IS NULL AND a.post IS NOT NULL THEN (SELECT arg_min(f.pre, f.pre_start) FROM s f WHERE f.commit_id = a.commit_id AND f.post = a.post AND f.pre IS NOT NULL) ELSE a.pre END AS tpre FROM s a),
    e AS (SELECT commit_id, arg_min(struct_pack(tpre := tpre, tpost := tpost), pre_start) AS tgt FROM h WHERE (pre IS NULL) <> (post IS NULL) GROUP BY 1),
    r AS (SELECT h.commit_id, h.path, CASE WHEN h.pre IS NULL AND h.post IS NULL AND e.tgt IS NOT NULL THEN e.tgt.tpre ELSE h.tpre END AS pre,
      CASE WHEN h.pre IS NULL AND h.post IS NULL AND e.tgt IS NOT NULL THEN e.tgt.tpost ELSE h.tpost END AS post, pre_start, pre_end, post_start, post_end, n_hunks
      FROM h LEFT JOIN e ON h.commit_id = e.commit_id)
    SELECT commit_id, path, pre, post, min(pre_start) AS pre_start, max(pre_end) AS pre_end, min(post_start) AS post_start, max(post_end) AS post_end,
    CAST(sum(n_hunks) AS BIGINT) AS n_hunks FROM r GROUP BY 1, 2, 3, 4""",
)
def q_merge_hunks(t):
    return df_.merge_hunks(t.v_hunks)


VIEWS["v_changed_lines"] = """
SELECT DISTINCT d.doc_id AS id, CAST(1 + l.l_partkey % 30 AS INT) AS line_no FROM {lineitem} l JOIN {documents} d ON l.l_orderkey = d.doc_id"""

VIEWS["v_doc_functions"] = """
SELECT doc_id AS id, CAST(4 AS INT) AS start_line, CAST(6 + doc_id % 3 AS INT) AS end_line FROM {documents} WHERE n_chars > 1000"""


@query(
    "q_context_lines",
    """WITH f AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents),
    c AS (SELECT v.id, v.line_no, f.lines, len(f.lines) AS n, e.start_line, e.end_line FROM {v_changed_lines} v JOIN f ON v.id = f.id
      LEFT JOIN {v_doc_functions} e ON v.id = e.id AND v.line_no BETWEEN e.start_line AND e.end_line WHERE v.line_no <= len(f.lines)),
    k AS (SELECT *, CASE WHEN start_line IS NULL THEN 0 ELSE coalesce((SELECT min(j) FROM range(1, start_line) r(j) WHERE NOT (trim(lines[start_line - j]) = '' OR regexp_matches(trim(lines[start_line - j]), '^(\\*|/\\*|#)'))), start_line) - 1 END AS run FROM c),
    s AS (SELECT id, lines, CASE WHEN start_line IS NULL THEN greatest(line_no - 2, 1) ELSE start_line - run END AS a,
      CASE WHEN start_line IS NULL THEN least(line_no + 2, n) ELSE least(end_line, n) END AS b FROM k
      WHERE start_line IS NOT NULL OR trim(lines[line_no]) <> ''),
    l AS (SELECT DISTINCT id, unnest(range(CAST(a AS BIGINT), CAST(b AS BIGINT) + 1)) AS i FROM s)
    SELECT l.id, CAST(count(*) AS INT) AS n_lines, md5(string_agg(f.lines[l.i], chr(10) ORDER BY l.i)) AS digest FROM l JOIN f ON l.id = f.id GROUP BY 1""",
)
def q_context_lines(t):
    files = t.documents.select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("lines"))
    out = df_.context_snippets(t.v_changed_lines, files, t.v_doc_functions, "id", around=2)
    return out.select("id", F.size("covered").alias("n_lines"), F.md5("snippet").alias("digest"))
