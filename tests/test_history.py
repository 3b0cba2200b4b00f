"""Process metrics against a plain loop over commits, with one author and one file in most commits."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import history as h


def make(seed=3, commits=120):
    rnd = random.Random(seed)
    out = []
    day0 = datetime.datetime(2020, 1, 1)
    for c in range(commits):
        author = "bot" if rnd.random() < 0.5 else f"a{rnd.randint(0, 6)}"
        when = day0 + datetime.timedelta(days=rnd.randint(0, 40))
        files = {"CHANGES"} if rnd.random() < 0.5 else set()
        while len(files) < 1 + rnd.randint(0, 3):
            files.add(f"s{rnd.randint(0, 2)}/d{rnd.randint(0, 1)}/f{rnd.randint(0, 5)}.c")
        for f in files:
            out.append((c, f, author, when, rnd.randint(0, 9), rnd.randint(0, 4), rnd.randint(0, 90)))
    return out


SCHEMA = "commit_id int, path string, author string, commit_date timestamp_ntz, lines_added bigint, lines_deleted bigint, lines_before bigint"


def by_loop(rows):
    commits = {}
    for r in rows:
        commits.setdefault((r[3], r[0]), []).append(r)
    authors, files, result = {}, {}, {}
    for (when, cid), rs in sorted(commits.items()):
        me = rs[0][2]
        mine = authors.setdefault(me, {})
        devs, nuc, ages = set(), 0, []
        for r in rs:
            f = files.setdefault(r[1], {"authors": set(), "n": 0, "last": None})
            ages.append((when - f["last"]).days if f["last"] else 0)
            f["authors"].add(me)
            f["n"] += 1
            f["last"] = when
            devs |= f["authors"]
            nuc += f["n"]
            mine.setdefault(r[1], []).append(when)
        sub = lambda p: p.split("/")[0] if "/" in p else "root"
        subs = {sub(r[1]) for r in rs}
        n = [r[4] + r[5] for r in rs]
        total = sum(n)
        result[cid] = {
            "ns": len(subs),
            "nd": len({r[1].rsplit("/", 1)[0] if "/" in r[1] else "root" for r in rs}),
            "nf": len({r[1].rsplit("/", 1)[-1] for r in rs}),
            "entropy": -sum(x / total * math.log2(x / total) for x in n if x) if total else 0.0,
            "la": sum(r[4] for r in rs), "ld": sum(r[5] for r in rs), "lt": sum(r[6] for r in rs),
            "ndev": len(devs), "nuc": nuc, "age": sum(ages) / len(ages),
            "exp": sum(len(v) for v in mine.values()),
            "rexp": sum(1 / ((when - t).days + 1) for v in mine.values() for t in v),
            "sexp": sum(sub(p) in subs for p in mine),
        }
    return result


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_metrics_equal_the_loop(spark, partitions):
    data = make()
    want = by_loop(data)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(data, SCHEMA).repartition(int(partitions) + 2)
        fixes = spark.createDataFrame([(1, 1)], "commit_id int, fix int")
        got = {r["commit_id"]: r.asDict() for r in h.process_metrics(df, fixes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.keys() == want.keys()
    for cid, w in want.items():
        for name, value in w.items():
            assert got[cid][name] == pytest.approx(value), (cid, name)
    assert got[1]["fix"] == 1 and got[2]["fix"] == 0


@pytest.mark.parametrize("block, in_row", [(512, 4096), (2, 4096), (3, 9), (1, 0)])
def test_developers_by_lists_and_by_joins(spark, block, in_row):
    data = make(5)
    df = spark.createDataFrame(data, SCHEMA)
    want = {c: w["ndev"] for c, w in by_loop(data).items()}
    got = h.developers(df, h.file_history(df), block=block, in_row=in_row)
    assert {r["commit_id"]: r["ndev"] for r in got.collect()} == want


def test_range_is_cut_after_the_history(spark):
    df = spark.createDataFrame(make(), SCHEMA)
    fixes = spark.createDataFrame([], "commit_id int, fix int")
    whole = {r["commit_id"]: r["exp"] for r in h.process_metrics(df, fixes).collect()}
    late = h.process_metrics(df, fixes, first_day="2020-01-20").collect()
    assert 0 < len(late) < len(whole)
    assert all(r["exp"] == whole[r["commit_id"]] for r in late)


def test_past_authors_exclude_the_commit(spark):
    t = datetime.datetime(2020, 1, 1)
    d = lambda n: t + datetime.timedelta(days=n)
    rows = [(1, "a.c", "x", d(0), 1, 0, 0), (2, "a.c", "y", d(1), 1, 0, 0), (3, "a.c", "x", d(2), 1, 0, 0), (3, "b.c", "x", d(2), 1, 0, 0)]
    commits = spark.createDataFrame([(1, "x", d(0)), (2, "y", d(1)), (3, "x", d(2))], "commit_id int, author string, commit_date timestamp_ntz")
    got = {r["commit_id"]: r for r in h.history_features(spark.createDataFrame(rows, SCHEMA), commits).collect()}
    assert (got[1]["past_authors"], got[1]["past_changes"]) == (0, 0)
    assert (got[2]["past_authors"], got[2]["author_touches"]) == (1, 0)
    assert (got[3]["past_authors"], got[3]["past_changes"], got[3]["author_touches"]) == (2, 2, 1)
    assert got[3]["author_share"] == pytest.approx(2 / 3)


def test_age_counts_parts_of_days(spark):
    from faultline.operators import history as h

    changes = [("c1", "f", "a", "2020-01-01 06:00:00"), ("c2", "f", "a", "2020-01-02 18:00:00"), ("c2", "g", "a", "2020-01-02 18:00:00")]
    df = spark.createDataFrame(changes, "commit_id string, path string, author string, d string").selectExpr("commit_id", "path", "author", "to_timestamp(d) AS commit_date")
    got = {r["commit_id"]: r["age"] for r in h.changes_and_age(h.file_history(df)).collect()}
    assert got == {"c1": 0.0, "c2": 0.75}


def test_own_metrics_send_every_row_once(spark):
    """Distinct counts in one aggregate would repeat every row per count before the shuffle."""
    df = spark.createDataFrame(make(), SCHEMA)
    plan = h.own_metrics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1


def test_scan_moves_no_inputs(spark):
    """What a running value adds up follows from the columns that move anyway."""
    from faultline.operators.scan import ordered_scan, running_sum

    df = spark.createDataFrame(make(), SCHEMA)
    out = ordered_scan(df, ["author"], h.WHEN, {"s": running_sum(F.col("lines_added") * 3)}, partitions=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :] if "RepartitionByExpression" in plan else plan
    assert "_in_s" not in below.split("LogicalRDD")[0]


def test_files_and_authors_without_a_name(spark):
    """A file without a name has no authors, and nobody knows the files of an author without one."""
    day = datetime.datetime(2020, 1, 1)
    rows = [(1, None, "a", day, 1, 0, 0), (1, "s/f", "a", day, 1, 0, 0), (2, "s/f", None, day + datetime.timedelta(1), 1, 0, 0)]
    touches = h.own_touches(spark.createDataFrame(rows, SCHEMA))
    history = {(r["commit_id"], r["path"]): r["file_authors"] for r in h._file_history(touches).collect()}
    assert history == {(1, None): 0, (1, "s/f"): 1, (2, "s/f"): 2}
    known = {r["commit_id"]: r["sexp"] for r in h._subsystem_experience(touches).collect()}
    assert known[2] == 0 and known[1] >= 1
