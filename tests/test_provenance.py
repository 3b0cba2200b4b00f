"""Blame tables in blocks, and lifetimes dealt over as many tasks as their rows need, on rows of the tests' own."""

import datetime
from types import SimpleNamespace

from pyspark.sql import functions as F

from faultline.operators import provenance as p
from faultline.plans import lifetimes as plans
from faultline.plans import load_all
from faultline.plans.registry import VIEWS

load_all()

HUNKS = "fix bigint, parent_no int, path string, hunk_id bigint, del_start bigint, del_count int, add_start bigint, add_count int, function string, summary string, cwe string"
BLAME = "commit_id bigint, version int, path string, line_no int, blame_commit bigint"


def _hunks_and_blame(spark):
    hunks = [
        (1, 1, "a.c", 1, 63, 3, 1, 2, "f", "flaw in f", "79"),
        (1, 1, "a.c", 2, 64, 1, 130, 0, "g", "flaw in f", "79"),
        (1, 2, "a.c", 3, 5, 2, 5, 1, "", None, "79"),
        (2, 1, "b.c", 1, 1, 2, 0, 0, "f", None, None),
        (3, 1, "c.py", 1, 1, 2, 1, 1, "f", None, None),
        (None, 1, "a.c", 1, 1, 2, 1, 1, "f", None, None),
    ]
    blame = [(1, v, "a.c", n, 10 + (n + v) % 4) for v in range(3) for n in range(1, 140)]
    blame += [(1, 1, "a.c", 64, 77), (1, 1, "a.c", 64, 77), (2, 1, "b.c", 1, None), (2, 1, "b.c", 2, 9), (None, 1, "a.c", 1, 5)]
    return spark.createDataFrame(hunks, HUNKS), spark.createDataFrame(blame, BLAME)


def test_blame_in_blocks_counts_as_blame_by_line(spark):
    """Also over block ends, with lines blamed twice, null commits, and a block in two rows."""
    hunks, blame = _hunks_and_blame(spark)
    entry = F.struct("version", "line_no", "blame_commit")
    blocks = blame.groupBy("commit_id", "path", p.block_of(F.col("line_no")).alias("block"), F.col("version") % 2).agg(F.collect_list(entry).alias("s"))
    blocks = blocks.select("commit_id", "path", "block", "s.version", "s.line_no", "s.blame_commit")
    for name in ("all_lines", "with_confidence"):
        by_line = sorted(map(tuple, p.run_heuristic(name, hunks, blame).collect()), key=str)
        assert by_line and sorted(map(tuple, p.run_heuristic(name, hunks, blocks).collect()), key=str) == by_line


def test_lines_of_a_file_do_not_travel(spark, sf_dir):
    """Blame and lines of the registered queries leave their files behind the exchange, not before."""
    from faultline.plans.provenance import _versions
    from faultline.plans.registry import Inputs

    lines, blame = _versions(Inputs(spark, sf_dir))
    assert "block" in blame.columns
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("REPARTITION_BY_COL")
    one = blame.select("commit_id", "path", "block").groupBy("commit_id", "path", "block").count()
    assert one.filter("count > 1").isEmpty()


def test_lifetimes_are_dealt_over_as_many_tasks_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr(plans, "ROWS_PER_TASK", 5)
    day = datetime.date(2020, 1, 1)
    lines = [(i % 40, i % 7, i % 3, 1 + i % 4, 3.0 + i % 9, 0.01 * (i % 5), "R" if i % 2 else "N", "F") for i in range(200)]
    lines += lines[:20]
    lineitem = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string")
    orders = spark.createDataFrame([(i, day + datetime.timedelta(i), f"{i % 3}-P") for i in range(40)], "o_orderkey bigint, o_orderdate date, o_orderpriority string")
    part = spark.createDataFrame([(i, f"Brand#{i}") for i in range(7)], "p_partkey bigint, p_brand string")
    tables = {"lineitem": lineitem, "orders": orders, "part": part}
    whole = spark.sql(VIEWS["v_lifetimes"], **tables)
    # 220 rows by 5 are more tasks than the session's own number of partitions
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < 44
    t = SimpleNamespace(spark=spark, v_lifetimes=whole, **tables)
    spread = plans._spread_lifetimes(t)
    assert spread.rdd.getNumPartitions() == 44
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(spread) == rows(whole)
    got = rows(plans._cves(t))
    monkeypatch.setattr(plans, "ROWS_PER_TASK", 10**9)
    assert got == rows(plans._cves(t))


def test_lifetimes_keep_their_tasks_below_the_session_number(spark, monkeypatch):
    """Fewer tasks than the session's number are given too, or adaptive execution merges them into tasks of any number of rows."""
    monkeypatch.setattr(plans, "ROWS_PER_TASK", 70)
    day = datetime.date(2020, 1, 1)
    lines = [(i % 40, i % 7, i % 3, 1 + i % 4, 3.0 + i % 9, 0.01 * (i % 5), "R" if i % 2 else "N", "F") for i in range(200)]
    lineitem = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string")
    orders = spark.createDataFrame([(i, day, f"{i % 3}-P") for i in range(40)], "o_orderkey bigint, o_orderdate date, o_orderpriority string")
    part = spark.createDataFrame([(i, f"Brand#{i}") for i in range(7)], "p_partkey bigint, p_brand string")
    tables = {"lineitem": lineitem, "orders": orders, "part": part}
    t = SimpleNamespace(spark=spark, v_lifetimes=spark.sql(VIEWS["v_lifetimes"], **tables), **tables)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 3
    spread = plans._spread_lifetimes(t)
    assert spread.rdd.getNumPartitions() == 3
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(spread) == rows(t.v_lifetimes)


def test_taken_apart_files_keep_their_tasks(spark, sf_dir, monkeypatch):
    """Adaptive execution does not merge them by what they take before their lines are made."""
    from faultline.plans import provenance as plan
    from faultline.plans.registry import Inputs

    monkeypatch.setattr(plan, "FILES_PER_TASK", 100)
    lines, _ = plan._versions(Inputs(spark, sf_dir))
    files = lines.filter("version = 0 AND line_no = 1").count()
    assert files > 400 and lines.rdd.getNumPartitions() == -(-files // 100)


def test_noise_in_blocks_is_noise_by_line(spark):
    """Comments over block ends, repeated lines and lines without text; noise does not meet candidates line by line."""
    from faultline.operators import diff as d

    hunks, _ = _hunks_and_blame(spark)
    code = {60: "a /* opens", 66: "closes */", 4: "", 5: "// note", 131: "int f(int a) {"}
    rows = [(1, v, "a.c", n, code.get(n + v, "x = g(1);")) for v in range(3) for n in range(1, 140)] + [(1, 0, "a.c", 70, None), (2, 1, "b.c", 1, "")]
    lines = spark.createDataFrame(rows + rows[:1], "commit_id bigint, version int, path string, line_no int, code string")
    hunks = p._code_hunks(hunks)
    got = p._without_noise(hunks, lines)
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    masked = d.comment_mask(lines, ["commit_id", "version", "path"], "line_no", "code").filter("masked").collect()
    noise = {(r.commit_id, r.version, r.path, r.line_no) for r in masked}
    assert (1, 1, "a.c", 64) in noise and (1, 2, "a.c", 63) in noise
    every = p._deleted(hunks).unionByName(p._around_additions(hunks)).select("hunk_id", *p._SPOT).collect()
    kept = sorted(map(str, (tuple(r) for r in got.select("hunk_id", *p._SPOT).collect())))
    want = [tuple(r) for r in every if tuple(r[1:3]) + tuple(r[3:]) not in noise and (r.version != 0 or r.hunk_id == 1)]
    assert any(tuple(r[1:]) in noise for r in every) and set(kept) <= set(map(str, map(tuple, every)))
    assert sorted(k for k in kept if ", 0, " not in k) == sorted(str(w) for w in want if w[2] != 0)
