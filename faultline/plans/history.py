"""Process metrics on the supplied tables."""

from pyspark.sql import functions as F

from faultline.functions.columns import big, r6
from faultline.operators import history as h
from faultline.plans.registry import VIEWS, query
from faultline.session import stored

VIEWS["v_fix_flag"] = """
SELECT l_orderkey AS commit_id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS fix FROM {lineitem} GROUP BY l_orderkey"""

# --- oracle-only views: windows and self-joins, written independently of the operators ------------
VIEWS["o_sub"] = """
SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS sub,
       CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE 'root' END AS dir,
       regexp_extract(path, '[^/]*$') AS name FROM {v_file_changes}"""

VIEWS["o_file_win"] = """
SELECT *, row_number() OVER w AS nth, lag(commit_date) OVER w AS prev_date FROM {v_file_changes}
WINDOW w AS (PARTITION BY path ORDER BY commit_date, commit_id)"""

VIEWS["o_nuc"] = """
SELECT commit_id, sum(nth) AS nuc, avg(coalesce(greatest(date_diff('day', prev_date, commit_date), 0), 0)) AS age,
       sum(nth - 1) AS past_changes FROM {o_file_win} GROUP BY 1"""

VIEWS["o_ndev"] = """
SELECT a.commit_id, count(DISTINCT b.author) AS ndev FROM {v_file_changes} a JOIN {v_file_changes} b ON a.path = b.path
 AND (b.commit_date, b.commit_id) <= (a.commit_date, a.commit_id) GROUP BY 1"""

VIEWS["o_touch"] = """
SELECT author, commit_id, commit_date, count(*) AS touches FROM {v_file_changes} GROUP BY 1, 2, 3"""

VIEWS["o_exp"] = """
SELECT a.commit_id, sum(b.touches) AS exp, sum(b.touches / (date_diff('second', b.commit_date, a.commit_date) / 86400 + 1)) AS rexp
FROM {o_touch} a JOIN {o_touch} b ON a.author = b.author AND (b.commit_date, b.commit_id) <= (a.commit_date, a.commit_id)
GROUP BY 1"""

VIEWS["o_sexp"] = """
SELECT a.commit_id, count(DISTINCT b.path) AS sexp FROM {o_sub} a JOIN {o_sub} b ON a.author = b.author AND a.sub = b.sub
 AND (b.commit_date, b.commit_id) <= (a.commit_date, a.commit_id) GROUP BY 1"""

VIEWS["o_entropy"] = """
SELECT commit_id, coalesce(-sum(CASE WHEN n > 0 THEN (n / t) * log2(n / t) ELSE 0 END), 0) + 0.0 AS entropy
FROM (SELECT commit_id, lines_added + lines_deleted AS n, sum(lines_added + lines_deleted) OVER (PARTITION BY commit_id) AS t
      FROM {v_file_changes}) GROUP BY 1"""

VIEWS["o_own"] = """
SELECT commit_id, author, commit_date, count(DISTINCT sub) AS ns, count(DISTINCT dir) AS nd, count(DISTINCT name) AS nf,
       CAST(sum(lines_added) AS BIGINT) AS la, CAST(sum(lines_deleted) AS BIGINT) AS ld, CAST(sum(lines_before) AS BIGINT) AS lt
FROM {o_sub} GROUP BY 1, 2, 3"""


@query("q_entropy", "SELECT commit_id, round(entropy, 6) AS entropy FROM {o_entropy}")
def q_entropy(t):
    return h.entropy(t.v_file_changes).select("commit_id", r6("entropy", "entropy"))


@query("q_change_size", "SELECT commit_id, la, ld, lt FROM {o_own}")
def q_change_size(t):
    return h.change_size(t.v_file_changes)


@query(
    "q_prev_touch",
    "SELECT commit_id, path, prev_date FROM {o_file_win}",
)
def q_prev_touch(t):
    return h.file_history(t.v_file_changes).select("commit_id", "path", "prev_date")


@query("q_nuc", "SELECT commit_id, CAST(nuc AS BIGINT) AS nuc FROM {o_nuc}")
def q_nuc(t):
    return h.changes_and_age(h.file_history(t.v_file_changes)).select("commit_id", "nuc")


@query("q_age", "SELECT commit_id, round(age, 6) AS age FROM {o_nuc}")
def q_age(t):
    return h.changes_and_age(h.file_history(t.v_file_changes)).select("commit_id", r6("age", "age"))


@query("q_ndev", "SELECT commit_id, ndev FROM {o_ndev}")
def q_ndev(t):
    changes = stored(t.v_file_changes, "file_changes")
    return h.developers(changes, stored(h.file_history(changes), "file_history")).select("commit_id", big("ndev", "ndev"))


@query("q_exp", "SELECT commit_id, CAST(exp AS BIGINT) AS exp FROM {o_exp}")
def q_exp(t):
    return h.experience(t.v_file_changes).select("commit_id", "exp")


@query("q_rexp", "SELECT commit_id, round(rexp, 6) AS rexp FROM {o_exp}")
def q_rexp(t):
    return h.recent_experience(h.author_touches(t.v_file_changes)).select("commit_id", r6("rexp", "rexp"))


@query("q_sexp", "SELECT commit_id, sexp FROM {o_sexp}")
def q_sexp(t):
    return h.subsystem_experience(t.v_file_changes).select("commit_id", big("sexp", "sexp"))


@query(
    "q_k_features",
    """SELECT o.commit_id, o.author, o.commit_date, o.ns, o.nd, o.nf, round(e.entropy, 6) AS entropy, o.la, o.ld, o.lt, f.fix,
    d.ndev, round(n.age, 6) AS age, CAST(n.nuc AS BIGINT) AS nuc, CAST(x.exp AS BIGINT) AS exp, round(x.rexp, 6) AS rexp, s.sexp
    FROM {o_own} o JOIN {o_entropy} e ON o.commit_id = e.commit_id JOIN {v_fix_flag} f ON o.commit_id = f.commit_id
    JOIN {o_ndev} d ON o.commit_id = d.commit_id JOIN {o_nuc} n ON o.commit_id = n.commit_id
    JOIN {o_exp} x ON o.commit_id = x.commit_id JOIN {o_sexp} s ON o.commit_id = s.commit_id
    WHERE CAST(o.commit_date AS DATE) >= DATE '1996-01-01'""",
)
def q_k_features(t):
    m = h.process_metrics(t.v_file_changes, t.v_fix_flag, first_day="1996-01-01")
    return m.select(
        "commit_id", "author", "commit_date", "ns", "nd", "nf", r6("entropy", "entropy"), "la", "ld", "lt", "fix",
        big("ndev", "ndev"), r6("age", "age"), "nuc", "exp", r6("rexp", "rexp"), big("sexp", "sexp"),
    )


@query(
    "q_history_features",
    """WITH p AS (SELECT a.commit_id, count(DISTINCT b.author) AS past_authors, count(*) FILTER (b.author = a.author) AS author_touches
      FROM {v_file_changes} a JOIN {v_file_changes} b ON a.path = b.path AND (b.commit_date, b.commit_id) < (a.commit_date, a.commit_id) GROUP BY 1),
    s AS (SELECT commit_id, row_number() OVER (PARTITION BY author ORDER BY commit_date, commit_id)
            / row_number() OVER (ORDER BY commit_date, commit_id) AS author_share FROM {v_commits})
    SELECT n.commit_id, coalesce(p.past_authors, 0) AS past_authors, coalesce(p.author_touches, 0) AS author_touches,
    CAST(n.past_changes AS BIGINT) AS past_changes, round(s.author_share, 6) AS author_share
    FROM {o_nuc} n LEFT JOIN p ON n.commit_id = p.commit_id JOIN s ON n.commit_id = s.commit_id""",
)
def q_history_features(t):
    out = h.history_features(t.v_file_changes, t.v_commits)
    return out.select(
        "commit_id", big("past_authors", "past_authors"), "author_touches", "past_changes", r6("author_share", "author_share")
    )


VIEWS["v_parents"] = """
SELECT DISTINCT l_orderkey AS commit_id, CASE WHEN l_discount > 0.09 THEN l_partkey ELSE 0 END AS parent_id FROM {lineitem}"""


@query(
    "q_commit_caps",
    """SELECT commit_id, count(*) AS files, CAST(max(lines_deleted) AS BIGINT) AS most_deleted, CAST(sum(lines_added + lines_deleted) AS BIGINT) AS changed
    FROM {v_file_changes} WHERE commit_id NOT IN (SELECT commit_id FROM {v_parents} GROUP BY 1 HAVING count(*) > 1)
    GROUP BY 1 HAVING count(*) < 6 AND max(lines_deleted) <= 9 AND sum(lines_added + lines_deleted) <= 150""",
)
def q_commit_caps(t):
    return h.commit_caps(t.v_file_changes, t.v_parents, max_files=6, max_deleted=9, max_changed=150)


VIEWS["v_file_types"] = """
SELECT commit_id, path, CASE WHEN lines_deleted = 0 THEN 'A' WHEN lines_added > 45 THEN 'R' ELSE 'M' END AS change_type FROM {v_file_changes}"""


@query(
    "q_modified_only",
    """SELECT commit_id, path, change_type FROM {v_file_types} WHERE change_type = 'M' AND commit_id IN (
      SELECT commit_id FROM {v_file_types} WHERE change_type = 'M' GROUP BY 1 HAVING count(*) <= 4)""",
)
def q_modified_only(t):
    return h.modified_only(t.v_file_types, max_files=4)
