"""Provenance of fixes on the supplied tables."""

from pyspark.sql import functions as F

from faultline.functions import text as x
from faultline.functions.columns import big, r6
from faultline.operators import history as h
from faultline.operators import provenance as p
from faultline.operators.quantiles import median_and_mad
from faultline.plans.registry import VIEWS, query
from faultline.session import stored

# --- fix-inducing changes ------------------------------------------------------------------------
VIEWS["v_fixes"] = """
SELECT c.commit_id, c.author AS issue, CAST(c.commit_date AS DATE) - 60 AS issue_date
FROM {v_commits} c JOIN {v_fix_flag} f ON c.commit_id = f.commit_id WHERE f.fix = 1"""

VIEWS["o_prev"] = """
SELECT commit_id, path, lag(commit_id) OVER (PARTITION BY path ORDER BY commit_date, commit_id) AS blame_commit FROM {v_file_changes}"""


def _removed(t):
    """Removed lines with the commit that last touched their file before."""
    from faultline.operators.scan import ordered_scan, previous

    changes = stored(t.v_file_changes.select("commit_id", "path", "commit_date"), "file_changes")
    prev = ordered_scan(changes, ["path"], h.WHEN, {"blame_commit": previous("commit_id")}).drop("commit_date")
    gone = t.v_lines.filter("side = 'del'").select("commit_id", "path", F.col("line_no").alias("line_a"), "code")
    return gone.join(prev, ["commit_id", "path"])


def _inducing(t):
    commits = t.v_commits.select("commit_id", F.to_date("commit_date").alias("commit_date"))
    return stored(p.inducing_lines(_removed(t), t.v_fixes, commits), "inducing_lines"), commits


VIEWS["o_induce"] = """
SELECT l.commit_id AS fix, f.issue, l.path, l.line_no AS line_a, b.blame_commit, CAST(c.commit_date AS DATE) AS blame_date
FROM {v_lines} l JOIN {o_prev} b ON l.commit_id = b.commit_id AND l.path = b.path JOIN {v_fixes} f ON f.commit_id = l.commit_id
JOIN {v_commits} c ON c.commit_id = b.blame_commit
WHERE l.side = 'del' AND NOT regexp_matches(l.code, '#|//|/\\*|\\*/') AND trim(l.code) <> '' AND CAST(c.commit_date AS DATE) <= f.issue_date"""

VIEWS["o_induce_n"] = """
SELECT blame_commit, count(*) AS bug_count, count(DISTINCT fix) AS n_fixes, count(DISTINCT issue) AS n_issues FROM {o_induce} GROUP BY 1"""

VIEWS["o_mad"] = """
SELECT m AS median, median(abs(n_issues - m)) AS mad FROM {o_induce_n}, (SELECT median(n_issues) AS m FROM {o_induce_n}) GROUP BY m"""

VIEWS["o_days"] = """
SELECT DISTINCT i.blame_commit, i.fix, CAST(date_diff('day', i.blame_date, CAST(c.commit_date AS DATE)) AS INT) AS days
FROM {o_induce} i JOIN {v_commits} c ON c.commit_id = i.fix"""


@query(
    "q_szz",
    """SELECT blame_commit, bug_count, n_fixes, n_issues FROM {o_induce_n}, {o_mad}
    WHERE n_issues <= median + 3 * 1.4826 * CASE WHEN mad = 0 THEN 1 ELSE mad END""",
)
def q_szz(t):
    return p.fix_inducing(_inducing(t)[0])


@query(
    "q_mad_bound",
    """SELECT 'issues' AS what, CAST(median AS DOUBLE) AS median, CAST(mad AS DOUBLE) AS mad, round(median + 3 * 1.4826 * CASE WHEN mad = 0 THEN 1 ELSE mad END, 6) AS upper FROM {o_mad}
    UNION ALL SELECT 'days', m, median(abs(days - m)), round(m + 3 * median(abs(days - m)), 6) FROM {o_days}, (SELECT median(days) AS m FROM {o_days}) GROUP BY m""",
)
def q_mad_bound(t):
    lines, commits = _inducing(t)
    issues = p.issue_bound(p.inducing_counts(lines)).withColumn("what", F.lit("issues"))
    days = p.time_bound(p.fix_times(lines, commits), "days").withColumn("what", F.lit("days"))
    return issues.unionByName(days).select("what", "median", "mad", r6("upper", "upper"))


@query(
    "q_fix_time_stats",
    """SELECT round(avg(days), 6) AS mean, CAST(median(days) AS DOUBLE) AS median,
    CAST((list(days ORDER BY days DESC))[CAST(floor(count(*) * 0.1) AS BIGINT) + 1] AS DOUBLE) AS at_share FROM {o_days}""",
)
def q_fix_time_stats(t):
    lines, commits = _inducing(t)
    out = p.fix_time_stats(p.fix_times(lines, commits))
    return out.select(r6("mean", "mean"), F.col("median").cast("double").alias("median"), "at_share")


# --- blame heuristics ----------------------------------------------------------------------------
VIEWS["v_prov_hunks"] = """
SELECT t.commit_id AS fix, CASE WHEN max(l.l_discount) > 0.08 THEN 2 ELSE 1 END AS parent_no, t.path, CAST(t.line_no AS BIGINT) AS hunk_id,
       t.line_no AS del_start, CAST(min(t.lines_added) % 3 AS INT) AS del_count, t.line_no AS add_start, CAST(max(t.lines_added) % 4 AS INT) AS add_count,
       split_part(min(pa.p_name), ' ', 1) AS function
FROM {v_touched} t JOIN {lineitem} l ON l.l_orderkey = t.commit_id AND l.l_partkey = t.partkey AND l.l_linenumber = t.line_no AND l.l_suppkey = t.suppkey
JOIN {part} pa ON pa.p_partkey = t.partkey JOIN {v_fix_flag} f ON f.commit_id = t.commit_id WHERE f.fix = 1
GROUP BY t.commit_id, t.path, t.line_no"""

VIEWS["v_fix_notes"] = """
SELECT l.l_orderkey AS fix, concat('flaw in ', min(p.p_name)) AS summary, CASE WHEN min(l.l_suppkey) % 10 = 0 THEN '264' ELSE '79' END AS cwe
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey"""

_CODE = """CASE (line_no + version + lines_before) % 6 WHEN 0 THEN '' WHEN 1 THEN '/* note' WHEN 2 THEN 'end */ f(x);'
    WHEN 3 THEN 'if (a) return;' WHEN 4 THEN 'static int f(int a) {' ELSE 'int y = 2;' END"""

VIEWS["o_versions"] = f"""
SELECT commit_id, version, path, line_no, code, blame_commit FROM (
  SELECT commit_id, version, path, line_no, {_CODE} AS code, CASE WHEN (line_no + version) % 2 = 0 THEN prev ELSE nullif(first, commit_id) END AS blame_commit
  FROM (SELECT c.commit_id, c.path, c.lines_before, lag(c.commit_id) OVER w AS prev, first_value(c.commit_id) OVER w AS first
        FROM {{v_file_changes}} c WINDOW w AS (PARTITION BY c.path ORDER BY c.commit_date, c.commit_id)) x,
       (SELECT CAST(unnest(range(0, 3)) AS INT) AS version) v, (SELECT CAST(unnest(range(1, 12)) AS INT) AS line_no) n)
WHERE commit_id IN (SELECT commit_id FROM {{v_fix_flag}} WHERE fix = 1)"""


FILES_PER_TASK = 25_000


def _versions(t):
    """Lines of the commit (version 0) and of two parents with their code, and the origin of each line, in blocks."""
    from faultline.operators.scan import ordered_scan, previous

    # each step is written, so that its shuffle files are gone before the next one's come
    changes = stored(t.v_file_changes.select("commit_id", "path", "commit_date", "lines_before"), "file_changes")
    first = changes.groupBy("path").agg(F.min_by("commit_id", F.struct(*h.WHEN)).alias("first"))
    hist = ordered_scan(changes, ["path"], h.WHEN, {"prev": previous("commit_id")}).join(first, "path")
    fixes = t.v_fix_flag.filter("fix = 1").select("commit_id")
    fixed = stored(hist.join(fixes, "commit_id", "left_semi"), "fixed_files")
    # files are dealt before they are taken apart into lines, so that lines need no way of their own; over so many tasks as these
    # lines need, since adaptive execution would merge the tasks by what the files take before
    n = -(-fixed.count() // FILES_PER_TASK)
    files = fixed.repartition(n, "commit_id", "path") if n > 1 else fixed.repartition("commit_id", "path")
    rows = files.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(
        "line_no", F.explode(F.sequence(F.lit(1), F.lit(11)))
    )
    lines = rows.select("commit_id", "version", "path", "line_no", F.expr(_CODE).alias("code"))

    def origin(version, line_no):
        commit = F.when((line_no + version) % 2 == 0, F.col("prev")).otherwise(F.nullif(F.col("first"), F.col("commit_id")))
        return F.named_struct(F.lit("version"), version.cast("tinyint"), F.lit("line_no"), line_no, F.lit("blame_commit"), commit)

    numbers = F.sequence(F.lit(1), F.lit(11))
    spots = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda v: F.transform(numbers, lambda n: origin(v, n))))
    known = F.filter(spots, lambda s: s["blame_commit"].isNotNull())
    blocks = F.explode(F.sequence(p.block_of(F.lit(1)), p.block_of(F.lit(11))))
    blame = fixed.select("commit_id", "path", known.alias("_s"), blocks.alias("block"))
    blame = blame.withColumn("_s", F.filter("_s", lambda s: p.block_of(s["line_no"]) == F.col("block"))).filter(F.size("_s") > 0)
    return lines, blame.select("commit_id", "path", "block", "_s.version", "_s.line_no", "_s.blame_commit")


def _hunks(t):
    return stored(t.v_prov_hunks.join(t.v_fix_notes, "fix", "left"), "hunks")


VIEWS["o_code_hunks"] = """
SELECT h.*, n.summary, n.cwe FROM {v_prov_hunks} h LEFT JOIN {v_fix_notes} n ON n.fix = h.fix WHERE regexp_matches(path, '\\.(c|h|cc|cpp)$')"""

VIEWS["o_cand"] = """
SELECT fix, parent_no, path, hunk_id, function, summary, parent_no AS version, CAST(unnest(range(del_start, del_start + del_count)) AS INT) AS line_no, FALSE AS added FROM {o_code_hunks}
UNION ALL SELECT fix, parent_no, path, hunk_id, function, summary, 0, add_start - 1, TRUE FROM {o_code_hunks} WHERE add_count > 0 AND add_start > 1
UNION ALL SELECT fix, parent_no, path, hunk_id, function, summary, 0, add_start + add_count, TRUE FROM {o_code_hunks} WHERE add_count > 0"""

VIEWS["o_cand_named"] = """
SELECT c.*, v.blame_commit, CASE WHEN c.function <> '' AND contains(lower(coalesce(summary, '')), lower(function)) THEN 3 ELSE 1 END AS w
FROM {o_cand} c JOIN {o_versions} v ON v.commit_id = c.fix AND v.version = c.version AND v.path = c.path AND v.line_no = c.line_no WHERE v.blame_commit IS NOT NULL"""


@query("q_vcc_a", "SELECT fix, blame_commit, count(*) AS weight FROM {o_cand_named} GROUP BY 1, 2")
def q_vcc_a(t):
    _, blame = _versions(t)
    return p.run_heuristic("all_lines", _hunks(t), blame)


VIEWS["o_vmask"] = """
SELECT commit_id, version, path, line_no, code, (code = '') OR NOT (NOT (coalesce(state0, FALSE) OR starts_with(code, '/*')) OR (contains(code, '*/') AND NOT ends_with(code, '*/'))) AS masked
FROM (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY commit_id, version, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state0
  FROM (SELECT *, CASE WHEN contains(code, '/*') THEN TRUE WHEN contains(code, '*/') THEN FALSE END AS state FROM {o_versions}))"""

VIEWS["o_block"] = """
SELECT h.fix, h.parent_no, h.path, h.hunk_id FROM {o_code_hunks} h
LEFT JOIN {o_versions} a ON a.commit_id = h.fix AND a.version = 0 AND a.path = h.path AND a.line_no = h.add_start
LEFT JOIN {o_versions} b ON b.commit_id = h.fix AND b.version = 0 AND b.path = h.path AND b.line_no = h.add_start + 1
LEFT JOIN {o_versions} c ON c.commit_id = h.fix AND c.version = 0 AND c.path = h.path AND c.line_no = h.add_start + 2
WHERE h.add_count > 0 AND CASE WHEN h.add_count = 1
  THEN coalesce(regexp_matches(a.code, 'if|else|goto|return|sizeof|break|NULL') OR regexp_matches(a.code, '[a-zA-Z_][a-zA-Z_0-9$]*\\(.*?\\)'), FALSE)
  ELSE NOT regexp_matches(trim(concat(a.code, b.code, c.code)), '^\\s*((inline|static)\\s+){0,2}\\w+\\s+\\*?\\s*\\w+\\s*\\([^!@#$+%^;]+?\\)\\s*\\{') END"""

VIEWS["o_clean"] = """
SELECT c.* FROM {o_cand_named} c JOIN {o_vmask} m ON m.commit_id = c.fix AND m.version = c.version AND m.path = c.path AND m.line_no = c.line_no
WHERE NOT m.masked AND (NOT c.added OR EXISTS (SELECT 1 FROM {o_block} b WHERE b.fix = c.fix AND b.parent_no = c.parent_no AND b.path = c.path AND b.hunk_id = c.hunk_id))"""


@query("q_vcc_b", "SELECT fix, blame_commit, count(*) AS weight FROM {o_clean} GROUP BY 1, 2")
def q_vcc_b(t):
    lines, blame = _versions(t)
    return p.run_heuristic("code_lines", _hunks(t), blame, lines)


@query(
    "q_vcc_c",
    "SELECT fix, blame_commit, CAST(sum(w) AS BIGINT) AS weight FROM {o_clean} WHERE parent_no = 1 GROUP BY 1, 2",
)
def q_vcc_c(t):
    lines, blame = _versions(t)
    return p.run_heuristic("named_function", _hunks(t), blame, lines)


@query(
    "q_vcc_confident",
    """WITH n AS (SELECT fix, blame_commit, CAST(sum(w) AS BIGINT) AS weight FROM {o_cand_named} GROUP BY 1, 2),
    r AS (SELECT fix, count(*) AS commits, sum(weight) AS total, max(weight) AS top, count(DISTINCT weight) AS levels FROM n GROUP BY 1),
    s AS (SELECT r.*, (SELECT count(*) FROM n WHERE n.fix = r.fix AND n.weight = r.top) AS n_top,
                 (SELECT max(weight) FROM n WHERE n.fix = r.fix AND n.weight < r.top) AS second FROM r)
    SELECT n.fix, n.blame_commit, n.weight, (c.cwe IS NULL OR c.cwe <> '264') AND s.n_top = 1
      AND (s.levels = 1 OR (s.top - s.second > s.total / 3 AND s.commits < 5)) AS confident
    FROM n JOIN s ON n.fix = s.fix LEFT JOIN {v_fix_notes} c ON c.fix = n.fix""",
)
def q_vcc_confident(t):
    _, blame = _versions(t)
    return p.run_heuristic("with_confidence", _hunks(t), blame)


@query(
    "q_vcc_lower",
    """SELECT fix, arg_max(blame_commit, (commit_date, blame_commit)) AS blame_commit, max(commit_date) AS commit_date FROM (
      SELECT h.fix, v.blame_commit, c.commit_date FROM (SELECT fix, path, parent_no, CAST(unnest(range(del_start, del_start + del_count)) AS INT) AS line_no FROM {v_prov_hunks}) h
      JOIN {o_versions} v ON v.commit_id = h.fix AND v.version = h.parent_no AND v.path = h.path AND v.line_no = h.line_no
      JOIN {v_commits} c ON c.commit_id = v.blame_commit) GROUP BY 1""",
)
def q_vcc_lower(t):
    _, blame = _versions(t)
    return p.heuristic_lower_bound(t.v_prov_hunks, blame, t.v_commits)


# --- mappings ------------------------------------------------------------------------------------
VIEWS["v_cves"] = "SELECT c_custkey AS cve, c_nationkey AS config, c_mktsegment AS segment FROM {customer}"
VIEWS["v_links"] = "SELECT o_custkey AS cve, o_orderkey AS sha FROM {orders}"
VIEWS["v_repo_commits"] = """
SELECT DISTINCT l.l_orderkey AS sha, c.c_nationkey AS config, o.o_orderdate AS commit_date
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey"""


def _cve_mappings(t, limit=None):
    configs = t.nation.select(F.col("n_nationkey").alias("config"), F.col("n_name").alias("config_name"))
    return p.cve_mappings(t.v_cves.select("cve", "config"), configs, t.v_links, t.v_repo_commits, limit)


@query(
    "q_cve_mappings",
    """SELECT DISTINCT v.cve, v.config, n.n_name AS config_name, k.sha, r.commit_date FROM {v_cves} v JOIN nation n ON n.n_nationkey = v.config
    JOIN {v_links} k ON k.cve = v.cve JOIN {v_repo_commits} r ON r.sha = k.sha AND r.config = v.config""",
)
def q_cve_mappings(t):
    return _cve_mappings(t)


VIEWS["v_known_ids"] = "SELECT CAST(p_partkey AS VARCHAR(20)) AS id, p_size AS cve FROM {part}"


@query(
    "q_id_mapping",
    """SELECT page_id, f.id, k.cve FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(url, '[0-9]+')) AS id FROM pages) f
    JOIN (SELECT DISTINCT id, cve FROM {v_known_ids}) k ON k.id = f.id""",
)
def q_id_mapping(t):
    ids = F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))
    return p.map_by_ids(t.pages, "page_id", ids, t.v_known_ids)


_REF_RULES = [
    {"contains": "example[.]com", "mode": "regex", "pattern": "/[a-z]{2}/[0-9]+"},
    {"contains": "example[.](net|org)", "mode": "cut", "pattern": "https?://[^/]*"},
]


@query(
    "q_reference_ids",
    """WITH f AS (SELECT DISTINCT page_id AS cve, id FROM (
      SELECT page_id, unnest(regexp_extract_all(url, '/[a-z]{2}/[0-9]+')) AS id FROM pages WHERE regexp_matches(url, 'example[.]com')
      UNION ALL SELECT page_id, replace(url, regexp_extract(url, 'https?://[^/]*'), '') FROM pages WHERE regexp_matches(url, 'example[.](net|org)') AND regexp_extract(url, 'https?://[^/]*') <> ''))
    SELECT id, CAST(part AS INT) AS part, array_to_string(list(cve ORDER BY cve), ',') AS cves
    FROM (SELECT id, cve, floor((row_number() OVER (PARTITION BY id ORDER BY cve) - 1) / 1000) AS part FROM f) GROUP BY id, part""",
)
def q_reference_ids(t):
    refs = t.pages.select(F.col("page_id").alias("cve"), F.col("url").alias("reference"))
    out = p.ids_from_references(refs, _REF_RULES)
    return out.select("id", "part", F.array_join(F.col("cves").cast("array<string>"), ",").alias("cves"))


@query(
    "q_sha_mapping",
    """SELECT DISTINCT k.sha, k.cve, k.sha IN (SELECT sha FROM {v_repo_commits}) AS in_repository FROM {v_links} k""",
)
def q_sha_mapping(t):
    return p.map_by_sha(t.v_links.select("sha", "cve"), t.v_repo_commits)


@query(
    "q_merge_maps",
    """SELECT id, value, count(*) AS n_sources FROM (SELECT l_partkey AS id, l_suppkey AS value FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N') GROUP BY 1, 2""",
)
def q_merge_maps(t):
    src = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select(
        F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("value")
    ).distinct()
    return p.merge_maps([src("R"), src("A"), src("N")])


@query(
    "q_advisory_flag",
    """WITH f AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(url), '[0-9]+')) AS cve,
      CASE WHEN starts_with(url, 'https') THEN 'yes' ELSE 'no' END AS v FROM pages)
    SELECT CAST(c.c_custkey AS VARCHAR) AS cve, coalesce(arg_max(f.v, f.page_id), 'no') AS stable FROM customer c
    LEFT JOIN f ON f.cve = CAST(c.c_custkey AS VARCHAR) GROUP BY 1""",
)
def q_advisory_flag(t):
    adv = t.pages.select(
        F.col("url").alias("text"), F.col("page_id").alias("advisory_id"),
        F.when(F.startswith("url", F.lit("https")), "yes").otherwise("no").alias("is_vulnerable"),
    )
    cves = t.customer.select(F.col("c_custkey").cast("string").alias("cve"))
    return p.advisory_flags(cves, adv, "[0-9]+")


@query(
    "q_enrich_cve",
    """SELECT m.cve, m.sha, v.c_mktsegment AS cwe, v.c_acctbal AS score, o.o_orderdate AS merge_date FROM {v_links} m
    LEFT JOIN customer v ON v.c_custkey = m.cve LEFT JOIN orders o ON o.o_orderkey = m.sha""",
)
def q_enrich_cve(t):
    info = t.customer.select(F.col("c_custkey").alias("cve"), F.col("c_mktsegment").alias("cwe"), F.col("c_acctbal").alias("score"))
    dates = t.orders.select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("merge_date"))
    return t.v_links.join(info, "cve", "left").join(dates, "sha", "left").select("cve", "sha", "cwe", "score", "merge_date")


@query(
    "q_fix_flag",
    """WITH f AS (SELECT page_id, ids[i] AS issue, i FROM (SELECT page_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM (
      SELECT page_id, regexp_extract_all(url, '[0-9]+') AS ids FROM pages)) WHERE ids[i] IN (SELECT id FROM {v_known_ids}))
    SELECT p.page_id, CASE WHEN count(f.issue) > 0 THEN 1 ELSE 0 END AS fix, coalesce(arg_max(f.issue, f.i), '') AS fix_issue
    FROM pages p LEFT JOIN f ON f.page_id = p.page_id GROUP BY 1""",
)
def q_fix_flag(t):
    messages = t.pages.select("page_id", F.col("url").alias("text"))
    return p.fix_flags(messages, "page_id", "[0-9]+", t.v_known_ids.select(F.col("id").alias("issue")))


@query(
    "q_mapping_coverage",
    """WITH f AS (SELECT page_id, unnest(regexp_extract_all(url, '[0-9]+')) AS id FROM pages),
    g AS (SELECT id, count(*) AS n, max(CASE WHEN id IN (SELECT id FROM {v_known_ids}) THEN 1 ELSE 0 END) AS hit FROM f GROUP BY 1)
    SELECT count(*) AS n_ids, count(*) FILTER (hit = 1) AS n_matched, CAST(sum(n * hit) AS BIGINT) AS rows_matched,
    round(100.0 * count(*) FILTER (hit = 1) / count(*), 6) AS pct_matched FROM g""",
)
def q_mapping_coverage(t):
    ids = t.pages.select("page_id", F.explode(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))).alias("id"))
    out = p.mapping_coverage(ids, t.v_known_ids, "page_id", "id")
    return out.select("n_ids", "n_matched", "rows_matched", r6("pct_matched", "pct_matched"))


VIEWS["v_mapped_messages"] = """
SELECT o.o_orderkey AS sha, CAST(o.o_custkey AS VARCHAR(20)) AS cve,
       concat(CASE o.o_orderstatus WHEN 'F' THEN 'Fixes: ' WHEN 'O' THEN 'security: ' ELSE 'see ' END, CAST(o.o_custkey AS VARCHAR(20))) AS message
FROM {orders} o"""


@query(
    "q_manual_review",
    """SELECT sha, cve, message FROM {v_mapped_messages} WHERE NOT (regexp_matches(message, '(F|f)ixes(:)?( )?' || cve) OR regexp_matches(message, '(S|s)ecurity(:)?( )' || cve))""",
)
def q_manual_review(t):
    # fixed values: phrases that usual messages hold
    phrases = ["(F|f)ixes(:)?( )?", "(S|s)ecurity(:)?( )", "(B|b)ug-(I|i)(d|)(:)?( )?"]
    return p.unusual_messages(t.v_mapped_messages, phrases)


@query(
    "q_group_mappings",
    """SELECT sha, CAST(part AS INT) AS part, string_agg(cve || ':' || segment, ';' ORDER BY cve) AS cves FROM (
      SELECT k.o_orderkey % 97 AS sha, v.c_custkey AS cve, replace(v.c_mktsegment, chr(10), '') AS segment,
      floor((row_number() OVER (PARTITION BY k.o_orderkey % 97 ORDER BY v.c_custkey) - 1) / 50) AS part
      FROM (SELECT DISTINCT o_orderkey % 97 AS o_orderkey, o_custkey FROM orders) k JOIN customer v ON v.c_custkey = k.o_custkey) GROUP BY 1, 2""",
)
def q_group_mappings(t):
    # few fixes with many CVEs each, so that the lists break into blocks
    links = t.orders.select((F.col("o_orderkey") % 97).alias("sha"), F.col("o_custkey").alias("cve")).distinct()
    clean = F.regexp_replace("segment", "[\r\n]", "")
    rows = links.join(t.v_cves.select("cve", "segment"), "cve")
    entry = F.concat_ws(":", F.col("cve").cast("string"), clean)
    out = p.blocked_lists(rows, ["sha"], ["cve"], entry, 50, "cves")
    return out.select("sha", "part", F.array_join("cves", ";").alias("cves"))


VIEWS["o_places"] = """
SELECT commit_id, project, row_number() OVER (PARTITION BY project ORDER BY commit_date, commit_id) AS place FROM {v_commits}"""


@query(
    "q_commit_distance",
    """SELECT a.commit_id AS older, b.commit_id AS newer, b.place - a.place AS distance FROM {o_prev} p
    JOIN {o_places} a ON a.commit_id = p.blame_commit JOIN {o_places} b ON b.commit_id = p.commit_id AND a.project = b.project
    GROUP BY 1, 2, 3""",
)
def q_commit_distance(t):
    from faultline.operators.scan import ordered_scan, previous

    prev = ordered_scan(
        t.v_file_changes.select("commit_id", "path", "commit_date"), ["path"], h.WHEN, {"older": previous("commit_id")}
    )
    pairs = prev.filter(F.col("older").isNotNull()).select("older", F.col("commit_id").alias("newer")).distinct()
    return p.commit_distance(pairs, t.v_commits)


# the orders of ten customers are one history: most follow the one before, some fork three before it, some merge a fourth
VIEWS["v_places"] = """
SELECT commit_id, CAST(floor(author / 10) AS BIGINT) AS repo, row_number() OVER (PARTITION BY CAST(floor(author / 10) AS BIGINT) ORDER BY commit_date, commit_id) AS place
FROM {v_commits}"""
VIEWS["v_commit_parents"] = """
SELECT a.commit_id, b.commit_id AS parent_id, CASE WHEN a.place - b.place = 4 THEN 1 ELSE 0 END AS parent_no
FROM {v_places} a JOIN {v_places} b ON a.repo = b.repo
WHERE b.place = a.place - CASE WHEN a.place % 7 = 3 THEN 3 ELSE 1 END OR (a.place % 5 = 0 AND b.place = a.place - 4)"""
VIEWS["v_commit_pairs"] = """
SELECT a.commit_id AS older, b.commit_id AS newer FROM {v_places} a JOIN {v_places} b ON a.repo = b.repo WHERE b.place IN (a.place + 12, a.place + 31, a.place - 2)"""


@query(
    "q_graph_distance",
    """WITH RECURSIVE w AS (SELECT commit_id, commit_id AS ancestor FROM {v_places} UNION SELECT w.commit_id, p.parent_id FROM w JOIN {v_commit_parents} p ON p.commit_id = w.ancestor)
    SELECT p.older, p.newer, CAST(count(*) FILTER (o.ancestor IS NULL) AS BIGINT) AS distance
    FROM {v_commit_pairs} p JOIN w n ON n.commit_id = p.newer LEFT JOIN w o ON o.commit_id = p.older AND o.ancestor = n.ancestor GROUP BY 1, 2""",
)
def q_graph_distance(t):
    from faultline.operators.commit_graph import graph_distance

    return graph_distance(t.v_commit_pairs, t.v_commits, t.v_commit_parents)
