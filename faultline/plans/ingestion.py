"""Scans and parsers: tables are written in the format under test, or turned into its text, and read back."""

from pyspark.sql import functions as F

from faultline.functions import dates as dt
from faultline.functions.columns import big, r6
from faultline.operators.scan import last_value, ordered_scan
from faultline.plans.registry import VIEWS, query
from faultline.session import shared_folder
from faultline.sinks import tables as k
from faultline.sources import files as s


@query("q_read_results", "SELECT CAST(id AS VARCHAR) AS commit_sha, CAST(y_true AS DOUBLE) AS y_true, round(y_pred, 6) AS y_pred FROM {v_predictions}")
def q_read_results(t):
    """Two files with a header, one without, and one that is missing."""
    pred = t.v_predictions
    out = []
    for model, header in (("m1", True), ("m2", True), ("m3", False)):
        path = shared_folder(t.spark, f"results-{model}")
        rows = pred.filter(F.col("model") == model).select(F.col("id").alias("commit_sha"), "y_true", "y_pred")
        k.save(rows, path, "csv", header=header, sep="\t")
        out.append(s.read_results(t.spark, path, header=header))
    out.append(s.read_results(t.spark, shared_folder(t.spark, "results-missing")))
    return s.union_by_name(out).withColumn("y_pred", F.round("y_pred", 6))


@query("q_parse_tail_fields", "SELECT model, id, y_true, round(round(y_pred, 4), 6) AS y_pred FROM {v_predictions}")
def q_parse_tail_fields(t):
    lead = F.when(F.col("model") == "m1", F.concat(F.col("id").cast("string"), F.lit("\t"))).otherwise("")
    value = F.concat(lead, F.col("y_true").cast("string"), F.lit(" \t"), F.round("y_pred", 4).cast("string"))
    lines = t.v_predictions.select("model", "id", value.alias("value"))
    return s.tail_fields(lines).select("model", "id", "y_true", r6("y_pred", "y_pred"))


@query(
    "q_union_missing_cols",
    """SELECT 'with_truth' AS project, l_partkey AS cve, l_returnflag AS fix, l_shipdate AS vcc_date FROM lineitem WHERE l_linestatus = 'F'
    UNION ALL SELECT 'without', l_partkey, l_returnflag, NULL FROM lineitem WHERE l_linestatus = 'O'""",
)
def q_union_missing_cols(t):
    full, bare = shared_folder(t.spark, "life-a"), shared_folder(t.spark, "life-b")
    rows = t.lineitem.select(F.col("l_partkey").alias("cve"), F.col("l_returnflag").alias("fix"), F.col("l_shipdate").alias("vcc_date"), "l_linestatus")
    opts = {"header": True, "sep": ";", "quote": "'"}
    k.save(rows.filter("l_linestatus = 'F'").drop("l_linestatus"), full, "csv", **opts)
    k.save(rows.filter("l_linestatus = 'O'").drop("l_linestatus", "vcc_date"), bare, "csv", **opts)
    return s.read_lifetime_files(
        t.spark,
        {"with_truth": [(full, "cve bigint, fix string, vcc_date timestamp_ntz")], "without": [(bare, "cve bigint, fix string")]},
    )


@query(
    "q_sql_source",
    """SELECT o_orderpriority AS project, count(DISTINCT o_custkey) AS authors FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def q_sql_source(t):
    text = "SELECT o_orderpriority AS project, count(DISTINCT o_custkey) AS authors FROM {commits} WHERE o_orderstatus = 'F' GROUP BY 1"
    return s.run_sql(t.spark, text, commits=t.orders)


@query(
    "q_range_scan",
    """SELECT o_orderkey, o_orderdate, o_custkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""",
)
def q_range_scan(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_custkey")
    return s.date_range(rows, "o_orderdate", "1996-01-01", "1996-12-31", "o_orderkey")


@query(
    "q_array_regex_scan",
    """SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^| )(red|b[a-z]+e)( |$)')""",
)
def q_array_regex_scan(t):
    rows = t.part.select("p_partkey", "p_name", F.split("p_name", " ").alias("words"))
    return s.any_matches(rows, "words", "^(RED|B[A-Z]+E)$").drop("words")


@query(
    "q_json_parse",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def q_json_parse(t):
    # the texts of one kind of event are broken on purpose
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    return t.events.select("event_id", s.typed_json(text, "k bigint")["k"].alias("k"))


@query(
    "q_arrays_zip",
    """SELECT doc_id * 1000000 + i AS id, line AS msg, CAST(length(line) AS INT) AS code FROM {o_doc_lines}""",
)
def q_arrays_zip(t):
    """Three parallel lists per document back to one row per place."""
    lines = F.split("text", "\n")
    lists = t.documents.select(
        F.transform(lines, lambda _, i: F.col("doc_id") * 1_000_000 + i).alias("ids"),
        lines.alias("msgs"),
        F.transform(lines, lambda x: F.length(x)).alias("codes"),
    )
    return s.zipped_rows(lists, id="ids", msg="msgs", code="codes")


@query(
    "q_ground_truth_text",
    """SELECT doc_id, substr(md5(line), 1, 8) AS vcc, substr(md5(line), 9, 8) AS fix, 'CVE-' || i AS cve FROM {o_doc_lines} WHERE i > 0 AND i % 4 <> 3""",
)
def q_ground_truth_text(t):
    def row(line, i):
        h = F.md5(line)
        mark = F.when(i % 8 == 3, "#").when(i % 8 == 7, "%").otherwise("")
        return F.concat(mark, F.substring(h, 1, 8), F.lit("  "), F.substring(h, 9, 8), F.lit("  CVE-"), i.cast("string"))

    text = F.array_join(F.transform(F.split("text", "\n"), row), "\r\n")
    return s.ground_truth_pairs(t.documents.select("doc_id", text.alias("text")), "doc_id", "text")


@query(
    "q_block_forward_fill",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block,
    CAST(len(regexp_extract_all(lower(text), '\\bth\\w+')) AS INT) AS n_found FROM conversations WHERE TRUE""",
)
def q_block_forward_fill(t):
    """Each row belongs to the last block header before it; ids are taken from the row."""
    rows = t.conversations
    header = F.when(F.col("role") == "user", F.col("turn"))
    filled = ordered_scan(rows, ["conv_id"], ["turn"], {"block": last_value(header)})
    found = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"\bth\w+"), F.lit(0)))
    return filled.select("conv_id", "turn", "block", found.alias("n_found"))


@query("q_path_metadata", "SELECT commit_id, project, label FROM {v_commits}")
def q_path_metadata(t):
    """Project and label are in the folder names only."""
    base = shared_folder(t.spark, "by-path")
    rows = t.v_commits.select("commit_id", "project", "label")
    k.save(rows.withColumn("kind", F.concat_ws("_", F.substring("project", 1, 1), "label")), base, "json", by=["kind"])
    raw = t.spark.read.schema("commit_id bigint, project string").option("recursiveFileLookup", "true").json(base)
    return s.from_path(raw, label=r"kind=\d_(\d)").select("commit_id", "project", F.col("label").cast("int").alias("label"))


@query(
    "q_invert_map",
    """SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS fix, CAST(o_custkey AS VARCHAR) AS cve FROM orders WHERE o_orderstatus <> 'P'""",
)
def q_invert_map(t):
    # a JSON map per order; open ones have no fix
    fix = F.when(F.col("o_orderstatus") == "P", "None").otherwise(F.col("o_orderkey").cast("string"))
    text = F.to_json(F.create_map(F.col("o_custkey").cast("string"), F.array(fix, fix)))
    return s.inverted_map(t.orders.select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query(
    "q_json_roundtrip",
    """SELECT commit_id, count(*) AS n_files, CAST(sum(lines_added) AS BIGINT) AS la FROM {v_file_changes} GROUP BY 1""",
)
def q_json_roundtrip(t):
    path = shared_folder(t.spark, "features-json")
    raw = t.v_file_changes.groupBy("commit_id").agg(
        F.struct(F.count(F.lit(1)).alias("n_files"), F.sum("lines_added").alias("la")).alias("features")
    )
    k.save(raw, path, "json")
    back = t.spark.read.schema("commit_id bigint, features struct<n_files bigint, la bigint>").json(path)
    return back.select("commit_id", "features.*")


# --- dates ---------------------------------------------------------------------------------------
_Y, _M, _D = "CAST(year(o_orderdate) + 16 AS VARCHAR(4))", "CAST(month(o_orderdate) AS INT)", "CAST(day(o_orderdate) AS VARCHAR(2))"
_MON = f"split_part('Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec', ' ', {_M})"

VIEWS["v_date_texts"] = f"""
SELECT o_orderkey, o_custkey, o_orderdate,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'qt' WHEN '2-HIGH' THEN 'eclipse' WHEN '3-MEDIUM' THEN 'gerrit' ELSE 'go' END AS project,
  CASE o_orderpriority WHEN '1-URGENT' THEN concat({_D}, ' ', {_MON}, ' ''', substr({_Y}, 3, 2), ' 10:5')
       WHEN '2-HIGH' THEN concat({_Y}, '-', CAST({_M} AS VARCHAR(2)), '-', {_D}, ' 08:07:06')
       WHEN '3-MEDIUM' THEN concat({_MON}, ' ', {_D}, ', ', {_Y})
       ELSE concat({_Y}, '-', CAST({_M} AS VARCHAR(2)), '-', {_D}) END AS text,
  CASE o_orderstatus WHEN 'F' THEN 'Fixed' WHEN 'O' THEN 'Bug open' ELSE 'Task' END AS status
FROM {{orders}}"""

VIEWS["o_dates"] = """
SELECT o_orderkey, o_custkey, status, CASE project WHEN 'qt' THEN make_timestamp(y, m, d, 10, 5, 59.0) WHEN 'eclipse' THEN make_timestamp(y, m, d, 8, 7, 6.0)
  ELSE make_timestamp(y, m, d, 23, 59, 59.0) END AS stamp
FROM (SELECT *, year(o_orderdate) + 16 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM {v_date_texts})"""


@query("q_parse_dates", "SELECT o_orderkey, stamp FROM {o_dates}")
def q_parse_dates(t):
    return t.v_date_texts.select("o_orderkey", dt.parse_project_date(F.col("text"), F.col("project")).alias("stamp"))


@query(
    "q_issue_ingest",
    """SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(o_orderkey, (stamp, o_orderkey)) AS msg, max(stamp) AS stamp FROM {o_dates}
    WHERE contains(status, 'Fix') OR contains(status, 'Bug') GROUP BY 1""",
)
def q_issue_ingest(t):
    """Bugs and fixed issues, the newest text of each id."""
    kept = t.v_date_texts.filter(F.contains("status", F.lit("Fix")) | F.contains("status", F.lit("Bug")))
    rows = kept.select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("msg"),
        dt.parse_project_date(F.col("text"), F.col("project")).alias("stamp"),
    )
    return k.upserted(rows.limit(0), rows, ["id"], "stamp", ties=["msg"])


@query(
    "q_month_calendar",
    """WITH p AS (SELECT o_orderpriority AS project, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
    m AS (SELECT project, CAST(unnest(range(date_trunc('month', a) + INTERVAL 1 MONTH, CASE WHEN date_trunc('month', b) = b THEN b ELSE date_trunc('month', b) + INTERVAL 1 MONTH END + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS m FROM p)
    SELECT project, m AS "start", e AS "end" FROM (SELECT project, m, lead(m) OVER (PARTITION BY project ORDER BY m) AS e FROM m) WHERE e IS NOT NULL""",
)
def q_month_calendar(t):
    span = t.orders.groupBy(F.col("o_orderpriority").alias("project")).agg(
        F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")
    )
    return span.select("project", F.inline(dt.month_intervals(F.col("a"), F.col("b"))))
