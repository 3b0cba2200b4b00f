"""Stand-in views: how the supplied tables play commits, file changes, scores and lifetimes.

Each text runs unchanged in Spark and in the oracle.
"""

from faultline.plans.registry import VIEWS

VIEWS["v_commits"] = """
SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS commit_date,
       o_orderpriority AS project, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
FROM {orders}"""

VIEWS["v_vulnerable"] = """
SELECT o_orderkey AS commit_id, o_orderdate AS commit_date, o_orderpriority AS project
FROM {orders} WHERE o_orderstatus = 'F'"""

# candidate safe commits; those with a low total overlap the vulnerable ones on purpose
VIEWS["v_safe"] = """
SELECT o_orderkey AS commit_id, o_orderdate AS commit_date, o_orderpriority AS project
FROM {orders} WHERE o_orderstatus <> 'F' OR o_totalprice < 250000"""

VIEWS["v_touched"] = """
SELECT l_orderkey AS commit_id, l_partkey AS partkey, l_linenumber AS line_no,
       CASE WHEN l_partkey % 13 = 0 THEN concat('f', CAST(l_partkey AS VARCHAR(20)), '.c')
            WHEN l_partkey % 11 = 0 THEN concat('sub', CAST(l_partkey % 7 AS VARCHAR(20)), '/d', CAST(l_partkey % 50 AS VARCHAR(20)), '/f', CAST(l_partkey AS VARCHAR(20)), '.py')
            ELSE concat('sub', CAST(l_partkey % 7 AS VARCHAR(20)), '/d', CAST(l_partkey % 50 AS VARCHAR(20)), '/f', CAST(l_partkey AS VARCHAR(20)), '.c') END AS path,
       CAST(floor(l_quantity) AS BIGINT) AS lines_added,
       CAST(round(100 * l_discount) AS BIGINT) AS lines_deleted,
       CAST(floor(l_extendedprice / 100) AS BIGINT) AS lines_before,
       l_returnflag AS flag, l_linestatus AS status, l_suppkey AS suppkey
FROM {lineitem}"""

# one row per (commit, path)
VIEWS["v_file_changes"] = """
SELECT t.commit_id, t.path, c.author, c.commit_date,
       CAST(sum(t.lines_added) AS BIGINT) AS lines_added,
       CAST(sum(t.lines_deleted) AS BIGINT) AS lines_deleted,
       CAST(max(t.lines_before) AS BIGINT) AS lines_before
FROM {v_touched} t JOIN {v_commits} c ON t.commit_id = c.commit_id
GROUP BY t.commit_id, t.path, c.author, c.commit_date"""

# one row per changed line with its text; equal line numbers of one commit and file are merged
VIEWS["v_lines"] = """
SELECT t.commit_id, t.path, CAST(t.line_no AS BIGINT) AS line_no,
       max(CASE WHEN t.flag = 'R' THEN concat('// ', p.p_name)
                WHEN t.flag = 'A' THEN concat('if (', p.p_name, ') return;')
                ELSE p.p_name END) AS code,
       max(CASE WHEN t.status = 'O' THEN 'add' ELSE 'del' END) AS side
FROM {v_touched} t JOIN {part} p ON t.partkey = p.p_partkey
GROUP BY t.commit_id, t.path, t.line_no"""

VIEWS["v_scored"] = """
SELECT l.doc_id AS id, l.toxic AS y_true,
       CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS m1,
       0.7 * CAST((l.doc_id * 7919) % 997 AS DOUBLE) / 997 + 0.3 * l.toxic AS m2
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"""

# m3 is m2 with many ties
VIEWS["v_predictions"] = """
SELECT 'm1' AS model, id, y_true, m1 AS y_pred FROM {v_scored}
UNION ALL SELECT 'm2' AS model, id, y_true, m2 AS y_pred FROM {v_scored}
UNION ALL SELECT 'm3' AS model, id, y_true, round(m2, 1) AS y_pred FROM {v_scored}"""

# sizes are known for documents that carry text of some length only
VIEWS["v_sizes"] = """
SELECT doc_id AS id, 1 + CAST(floor(n_chars / 40) AS BIGINT) AS lines
FROM {documents} WHERE n_chars > 120"""

VIEWS["v_messages"] = """
SELECT doc_id AS id, text, source AS project, lang FROM {documents}"""

VIEWS["v_lifetimes"] = """
SELECT l.l_partkey AS cve, l.l_orderkey AS fix, CAST(l.l_linenumber AS BIGINT) AS nr,
       p.p_brand AS category, o.o_orderpriority AS project,
       CAST(o.o_orderdate AS DATE) + CAST(30 * l.l_linenumber AS INT) AS fix_date,
       CAST(o.o_orderdate AS DATE) - CAST(floor(l.l_quantity) * 20 AS INT) AS est_date,
       CAST(o.o_orderdate AS DATE) - CAST(floor(l.l_quantity) * 24 AS INT) AS oldest_date,
       CAST(o.o_orderdate AS DATE) - CAST(floor(l.l_quantity) * 10 AS INT) AS newest_date,
       CASE WHEN l.l_orderkey % 3 = 0 THEN NULL
            ELSE CAST(o.o_orderdate AS DATE) - CAST(floor(l.l_quantity) * 18 AS INT) END AS true_date,
       l.l_tax * 100 + 0.5 * (l.l_orderkey % 2) AS score,
       CASE WHEN l.l_returnflag = 'R' THEN 'yes (stable)' ELSE 'no' END AS stable,
       l.l_linestatus = 'F' AS confident
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {part} p ON l.l_partkey = p.p_partkey"""
