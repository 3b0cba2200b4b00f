"""Files, table maintenance and the streaming form."""

import collections
import datetime
import itertools
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import dates as dt
from faultline.functions import text as x
from faultline.operators import lifetimes as lt
from faultline.operators import models as mo
from faultline.operators import statistics as st
from faultline.operators import vocabulary as vo
from faultline.operators.lookup import skew_lookup
from faultline.session import ensure_checkpoint_dir, shared_folder
from faultline.sinks import tables as k
from faultline.sources import files as s
from faultline.streaming.incremental import history_writer, late_rows, start_history_stream, state_table


def test_missing_results_are_empty(spark):
    got = s.read_results(spark, shared_folder(spark, "none"))
    assert got.columns == ["commit_sha", "y_true", "y_pred"] and got.count() == 0


def test_dataset_labels_as_text(spark, tmp_path):
    (tmp_path / "d.csv").write_text("commit_sha,commit_date,project,label,sources\na,2020-01-02 03:04:05,p,1.0,\"m,n\"\nb,,p,0,\n")
    got = {r["commit_sha"]: r for r in s.read_dataset(spark, str(tmp_path / "d.csv")).collect()}
    assert got["a"]["label"] == 1 and got["a"]["sources"] == ["m", "n"] and got["b"]["commit_date"] is None


def test_lifetime_file_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cve;fix\n'C;1';f1\n")
    (tmp_path / "b.csv").write_text("cve;fix;vcc\nC2;f2;v2\n")
    got = s.read_lifetime_files(
        spark, {"p": [(str(tmp_path / "a.csv"), "cve string, fix string"), (str(tmp_path / "b.csv"), "cve string, fix string, vcc string")]}
    )
    assert sorted(tuple(r) for r in got.select("cve", "fix").collect()) == [("C2", "f2"), ("C;1", "f1")]
    assert got.filter("vcc IS NULL").count() == 1


def test_ground_truth_skips_header_and_comments(spark, rows):
    text = "vcc  fix  cve\nv1  f1  CVE-1\r\n# note\n% note\nv2  f2  CVE-2\nshort  row\n"
    df = spark.createDataFrame([(1, text)], "f int, t string")
    assert rows(s.ground_truth_pairs(df, "f", "t"), "vcc", "fix", "cve") == [("v1", "f1", "CVE-1"), ("v2", "f2", "CVE-2")]


def test_tail_fields(spark, rows):
    df = spark.createDataFrame([("id\t1\t0.5",), ("0 0.25",), ("x",), ("a b nan?",)], "value string")
    assert rows(s.tail_fields(df), "y_true", "y_pred") == sorted([(1, 0.5), (0, 0.25), (None, None)], key=repr)


def test_upsert_newest_wins(spark, rows):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "id int, at int, v string")
    new = spark.createDataFrame([(1, 4, "late"), (2, 5, "same"), (3, 1, "new"), (3, 2, "newer")], "id int, at int, v string")
    assert rows(k.upserted(old, new, ["id"], "at"), "id", "v") == [(1, "a"), (2, "same"), (3, "newer")]


def test_resume_runs_each_id_once(spark):
    path, seen = shared_folder(spark, "t-resume"), []
    todo = spark.range(10)

    def work(d):
        seen.append(d.count())
        return d

    k.resume(todo.filter("id < 4"), "id", path, work)
    k.resume(todo, "id", path, work)
    assert seen == [4, 6] and spark.read.parquet(path).count() == 10


def test_saved_once(spark):
    path = shared_folder(spark, "t-once")
    k.saved_once(spark, path, lambda: spark.range(3))
    assert k.saved_once(spark, path, lambda: spark.range(99)).count() == 3


def test_guarded_errors_become_rows(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string").select(k.guarded(int, "bigint")("v").alias("r"))
    good, bad = k.split_failures(df, F.col("r.value"), F.col("r.error"), [])
    assert good.first()["value"] == 1 and "ValueError" in bad.first()["error"]


@pytest.mark.parametrize(
    "style, text, want",
    [
        ("day_first", "7 Mar '19 9:05", "2019-03-07 09:05:59"),
        ("full", "2018-3-4 05:06:07", "2018-03-04 05:06:07"),
        ("month_first", "Jan 5, 2015", "2015-01-05 23:59:59"),
        ("date_only", "2016-02-29", "2016-02-29 23:59:59"),
        ("date_only", "2 hours ago", None),
    ],
)
def test_date_styles(spark, style, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(dt.parse_date(F.col("t"), style)).first()[0]
    assert got == (datetime.datetime.fromisoformat(want) if want else None)


def test_tokens(spark):
    one = spark.createDataFrame([("Fix_me  a+b, don't",)], "t string")
    pick = lambda c: one.select(c).first()[0]
    assert pick(x.split_sentence(F.col("t"))) == "Fix me a + b , don't"
    assert pick(x.word_or_symbol_tokens(F.col("t"))) == ["fix", "me", "a", "+", "b", ",", "don't"]
    assert pick(x.token_windows(F.sequence(F.lit(1), F.lit(6)), 3, 1)) == [[1, 2, 3], [3, 4, 5], [5, 6]]
    assert pick(x.token_windows(F.array().cast("array<int>"), 3, 1)) == [[]]
    assert pick(x.format_change(F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"))) == "added_code:  a b removed_code: "


def test_roots_of_deep_trees_and_categories(spark, rows):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("x", "n00"), ("x", "n39")], "node string, parent string")
    got = {r["node"]: r["root"] for r in lt.roots(edges).collect()}
    assert len(got) == 41 and set(got.values()) == {"n40"}
    with pytest.raises(ValueError):
        lt.roots(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, parent string"))
    told = [("a", "p1", "PeerOf", "Primary", 1), ("a", "p2", "ChildOf", "Resultant", 2), ("a", "p3", "ChildOf", "Primary", 3), ("a", "p4", "ChildOf", "Primary", 4)]
    kept = lt.primary_parents(spark.createDataFrame(told, "node string, parent string, nature string, ordinal string, position int"))
    assert rows(kept) == [("a", "p3")]
    df = spark.createDataFrame([("CWE-119",), ("CWE-NVD-Other",), ("CWE-9999",), ("CWE-352",), ("CWE-601",)], "cwe string")
    assert rows(lt.with_category(df, "cwe"), "cwe", "cat") == [
        ("CWE-119", 1), ("CWE-352", 5), ("CWE-601", 4), ("CWE-9999", None), ("CWE-NVD-Other", 5)
    ]


def test_histogram_has_an_open_last_bin(spark, rows):
    df = spark.createDataFrame([(v,) for v in (0, 9, 10, 99, 100, 1001, 9000, None)], "v int")
    assert sorted(rows(vo.histogram(df, F.col("v"), 10, cap=100))) == [(0, 2), (10, 1), (90, 1), (100, 3)]
    assert sorted(rows(vo.histogram(df, F.col("v"), 1000))) == [(0, 5), (1000, 1), (9000, 1)]


def test_chi_square_tail_does_not_overflow(spark):
    df = spark.createDataFrame([(3.841459, 1), (5.991465, 2), (18.307038, 10), (0.0, 4), (812.0, 801), (5000.0, 800)], "x double, k int")
    got = [r[0] for r in df.select(st.chi_square_tail(F.col("x"), F.col("k"))).collect()]
    assert [round(v, 4) for v in got[:4]] == [0.05, 0.05, 0.05, 1.0] and 0.3 < got[4] < 0.5 and got[5] < 1e-200


def test_draws_beyond_the_limit_of_numpy():
    rng, sizes = np.random.default_rng(1), np.array([4 * 10**9, 10**6, 3, 6 * 10**9], np.int64)
    drawn = st.drawn_counts(rng, sizes, 2 * 10**9, 400)
    assert (drawn.sum(1) == 2 * 10**9).all() and (drawn >= 0).all() and (drawn <= sizes).all()
    assert np.allclose(drawn.mean(0)[[0, 3]], sizes[[0, 3]] / sizes.sum() * 2 * 10**9, rtol=1e-4)
    small = st.drawn_counts(rng, np.array([5, 7], np.int64), 6, 50)
    assert (small.sum(1) == 6).all()


def test_svm_weights_act_like_the_strength(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.7 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    margin = lambda **k: np.array([r["y_pred"] for r in mo.svm_scores(df, df, ["a", "b"], **k).orderBy("a").collect()])
    ten = margin(weight=F.lit(10.0), c=0.001)
    assert np.allclose(ten, margin(weight=F.lit(1.0), c=0.01), atol=1e-3)
    assert not np.allclose(ten, margin(weight=F.lit(1.0), c=0.001), atol=1e-2)


def test_logistic_fit_has_no_gradient_left(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = (x @ [1.0, -0.5] + rng.logistic(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "i int, a double, b double, label int")
    p = np.array([r["y_pred"] for r in mo.logistic_scores(df, df, ["a", "b"], c=2.0).orderBy("i").collect()])
    z = (x - x.mean(0)) / x.std(0)
    w, *_ = np.linalg.lstsq(np.c_[z, np.ones(400)], np.log(p / (1 - p)), rcond=None)
    gradient = np.r_[z.T @ (p - y) * 2.0 + w[:2], (p - y).sum()] / 400
    assert np.abs(gradient).max() < 1e-3


def test_true_lifetime_is_chosen_when_positive(spark):
    d = datetime.date
    cols = "project string, cve int, fix int, nr int, category string, fix_date date, est_date date, true_date date, newest_date date, score double, stable string, confident boolean"
    rows = [
        ("p", 1, 1, 1, None, d(2020, 1, 10), d(2020, 1, 1), None, d(2020, 1, 5), 5.0, "no", True),
        ("p", 1, 2, 1, "c", d(2020, 1, 20), d(2020, 1, 3), d(2020, 1, 15), d(2020, 1, 6), 6.0, "yes", False),
        ("p", 2, 1, 1, "c", d(2020, 1, 10), d(2020, 1, 1), d(2020, 2, 1), d(2020, 1, 5), 5.0, "no", True),
    ]
    got = {r["cve"]: r for r in lt.cve_lifetimes(spark.createDataFrame(rows, cols)).collect()}
    assert (got[1]["lifetime"], got[1]["h_lifetime"], got[1]["lifetime_lower"], got[1]["category"]) == (5, 19, 15, "c")
    assert got[1]["confident"] is False
    assert (got[2]["lifetime"], got[2]["c_lifetime"]) == (9, 0)


def test_permutation_agrees_with_plain_shuffling(spark):
    a, b = [1, 2, 2, 9, 9], [3, 8, 8, 9, 12, 14]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v int")
    got = st.pairwise_permutation(df, "g", "v", rounds=4000, seed=1).first()
    import itertools

    pool, n = a + b, len(a)
    gap = abs(sum(a) / n - sum(b) / len(b))
    hits = [
        abs(sum(pool[i] for i in c) / n - (sum(pool) - sum(pool[i] for i in c)) / len(b)) >= gap - 1e-9
        for c in itertools.combinations(range(len(pool)), n)
    ]
    assert got["rounds"] == 4000
    assert got["p_value"] == pytest.approx(sum(hits) / len(hits), abs=0.03)


def test_permutation_query_compares_every_pair_of_categories(spark, sf_dir, monkeypatch):
    from faultline.plans import load_all, statistics as plans
    from faultline.plans.registry import QUERIES

    load_all()
    real, asked = st.pairwise_permutation, []

    def few(df, group, value, rounds, seed):
        asked.append((rounds, {r[0] for r in df.select("category").distinct().collect()}))
        return real(df, group, value, rounds=2, seed=seed)

    monkeypatch.setattr(plans.st, "pairwise_permutation", few)
    got = {(r["a"], r["b"]) for r in QUERIES["q_permutation"](spark, sf_dir).collect()}
    [(rounds, names)] = asked
    assert rounds == 100_000 and len(names) > 5
    assert got == {(a, b) for a in names for b in names if a < b}


@pytest.mark.parametrize("values,take", [([3, -4, 10, 10, 7], 2), ([0, 1, 2, 300, 70_000, 5], 4), ([5, 6], 1), ([1, 2, 3], 3), ([1, 2, 3], 0)])
def test_every_subset_is_equally_likely(values, take):
    import collections
    import itertools

    import numpy as np

    rng, rounds = np.random.default_rng(3), 40_000
    got = collections.Counter(st.subset_sums(rng, np.array(values), take, rounds, cells=1000).tolist())
    want = collections.Counter(sum(values[i] for i in c) for c in itertools.combinations(range(len(values)), take))
    assert set(got) == set(want)
    for total, n in want.items():
        assert got[total] / rounds == pytest.approx(n / sum(want.values()), abs=0.015)


def test_both_ways_of_drawing_agree(monkeypatch):
    import numpy as np

    values, counts = np.array([1, 5, 9, 1000]), np.array([40, 3, 90, 7])
    sums = []
    for most in (0, 10**6):
        monkeypatch.setattr(st, "ROWS_PER_VALUE", most)
        sums.append(st.permuted_sums(np.random.default_rng(1), values, counts, 95, 20_000))
    assert sums[0].mean() == pytest.approx(sums[1].mean(), rel=0.02) and sums[0].std() == pytest.approx(sums[1].std(), rel=0.05)
    whole = int(values @ counts)
    assert sums[0].mean() == pytest.approx(whole * 95 / 140, rel=0.02)


def test_kruskal_and_tail(spark):
    df = spark.createDataFrame([(5.991464547, 2), (7.814727903, 3), (0.0, 1)], "x double, k int")
    assert [r[0] for r in df.select(st.chi_square_tail("x", "k")).collect()] == pytest.approx([0.05, 0.05, 1.0], abs=1e-6)
    r = st.kruskal(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "g string, v int"), "g", "v").first()
    assert (r["h"], r["df"]) == (pytest.approx(2.4), 1) and r["p_value"] == pytest.approx(0.121335, abs=1e-5)


def test_stream_restart_and_rerun(spark, rows):
    base = shared_folder(spark, "t-stream")
    t0 = datetime.datetime(2022, 1, 1)
    data = [(i, t0 + datetime.timedelta(hours=i), "hot" if i % 3 else f"f{i % 4}", f"a{i % 2}") for i in range(30)]
    schema = "commit_id int, commit_date timestamp_ntz, path string, author string"
    for part in (data[:11], data[11:12], data[12:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{base}/in")
        src = spark.readStream.schema(schema).parquet(f"{base}/in")
        start_history_stream(src, f"{base}/out", f"{base}/state", f"{base}/progress").awaitTermination()
    got = {r["commit_id"]: (r["file_changes"], r["prev_date"], r["exp"]) for r in spark.read.parquet(f"{base}/out").collect()}
    files, authors = {}, {}
    for cid, when, path, author in data:
        n, last = files.get(path, (0, None))
        authors[author] = authors.get(author, 0) + 1
        assert got[cid] == (n + 1, last, authors[author])
        files[path] = (n + 1, when)
    state = state_table(spark, f"{base}/state")
    want = sorted([("path", f, n) for f, (n, _) in files.items()] + [("author", a, n) for a, n in authors.items()])
    assert rows(state.read(), "kind", "key", "n") == want
    assert state.versions() == [2, 3]
    # the last batch once more
    last = spark.createDataFrame(data[12:], schema)
    history_writer(f"{base}/out", f"{base}/state")(last, 2)
    assert rows(state.read(), "kind", "key", "n") == want
    again = {r["commit_id"]: (r["file_changes"], r["prev_date"], r["exp"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert again == got
    # one key's state is read from one bucket
    one = state.near(spark.createDataFrame([("path", "hot")], "kind string, key string"))
    assert one.select(F.input_file_name()).distinct().count() == 1 and one.filter("key = 'hot'").count() == 1


def test_late_rows_are_set_apart(spark):
    """A row before what is known of its file or author is neither counted nor lost; null authors and paths are no one's."""
    base = shared_folder(spark, "t-late")
    day = lambda n: datetime.datetime(2022, 1, n)
    schema = "commit_id int, commit_date timestamp_ntz, path string, author string"
    batches = [
        [(3, day(3), "f", "a"), (1, day(1), "f", "a"), (2, day(2), "g", "b")],
        [(4, day(2), "f", "c"), (5, day(2), "h", "a"), (6, day(3), "f", "b"), (7, day(1), None, None), (8, day(4), "f", "a")],
    ]
    for part in batches:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{base}/in")
        src = spark.readStream.schema(schema).parquet(f"{base}/in")
        start_history_stream(src, f"{base}/out", f"{base}/state", f"{base}/progress").awaitTermination()
    late = {r["commit_id"] for r in spark.read.parquet(late_rows(f"{base}/out")).collect()}
    assert late == {4, 5}
    got = {r["commit_id"]: (r["file_changes"], r["exp"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {1: (1, 1), 3: (2, 2), 2: (1, 1), 6: (3, 2), 7: (1, 1), 8: (4, 3)}


def _context(master, named=None, now=None):
    made = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: now, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: named or default)), made


def test_checkpoint_folder_rule():
    cluster, made = _context("spark://host:7077")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(cluster)
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn", "local[4]"):
        cluster, made = _context(master, "hdfs://shared/ckpt")
        ensure_checkpoint_dir(cluster)
        assert made == ["hdfs://shared/ckpt"]
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(_context("local-cluster[3,2,1024]")[0])
    alone, made = _context("local[8]")
    ensure_checkpoint_dir(alone)
    assert len(made) == 1
    kept, made = _context("yarn", "hdfs://x", "hdfs://already")
    ensure_checkpoint_dir(kept)
    assert made == []


def test_lookup_reads_the_facts_once_and_spreads_hot_keys(spark, rows):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 500).cast("int").alias("k"))
    dim = spark.createDataFrame([(i, f"v{i}", 100 - i) for i in range(450)], "k int, v string, w int")
    for hot in (0, 1, 20, 1000):
        got = skew_lookup(facts, dim, "k", "w", hot_rows=hot, always_hot=F.col("k") == 7)
        assert rows(got) == rows(facts.join(dim, "k", "left").select("id", "k", "v", "w"))
        inner = skew_lookup(facts, dim, "k", "w", how="inner", hot_rows=hot)
        assert rows(inner) == rows(facts.join(dim, "k").select("id", "k", "v", "w"))
    plan = skew_lookup(facts, dim, "k", "w")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 3000") == 1


def test_decoding_many_unknown_tokens(spark, rows):
    """Nine of ten tokens are unknown and the vocabulary has more words than the hot table."""
    vocab = spark.range(11_000).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") + 2).alias("id"), (F.col("id") % 9 + 1).alias("freq"))
    vocab = vocab.unionByName(spark.createDataFrame([("<NULL>", 0, 0)], "token string, id bigint, freq bigint"))
    texts = spark.range(60).select("id", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.when(i % 10 == 0, F.concat(F.lit("w"), F.col("id") * 150 + i)).otherwise(F.concat(F.lit("u"), i))).alias("t"))
    ids = vo.encode_tokens(texts, "id", F.col("t"), vocab)
    back = {r["id"]: r["tokens"] for r in vo.decode_tokens(ids, "id", F.col("ids"), vocab).collect()}
    assert all(back[i] == [f"w{i * 150 + j}" if j % 10 == 0 and i * 150 + j < 11_000 else "<NULL>" for j in range(20)] for i in range(60))


def test_in_row_dictionary_moves_no_document_and_keeps_its_bound(spark):
    from tests.test_plans import plan

    vocab = spark.createDataFrame([(f"w{i}", i, i % 5) for i in range(300)] + [("", 300, 1), ("\u00e9", 301, 1)], "token string, id bigint, freq bigint")
    texts = spark.range(200).select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("W"), F.col("id") * 2 + i)).alias("t"))
    texts = texts.unionByName(spark.sql("SELECT 999 AS id, array('', null, '\u00e9', 'nothing') AS t")).unionByName(spark.sql("SELECT 1000 AS id, cast(null AS array<string>) AS t"))
    ids = vo.encode_tokens(texts, "id", F.col("t"), vocab, most=302, null_id=-1)
    got = {r["id"]: r["ids"] for r in ids.collect()}
    assert all(got[i] == [i * 2 + j if i * 2 + j < 300 else -1 for j in range(10)] for i in range(200))
    assert got[999] == [300, -1, 301, -1] and got[1000] is None
    main = plan(spark, ids).split("===== Subqueries =====")[0]
    assert "Exchange" not in main and "Join" not in main
    back = {r["id"]: r["tokens"] for r in vo.decode_tokens(ids, "id", F.col("ids"), vocab, most=302).collect()}
    assert back[3] == [f"w{6 + j}" for j in range(10)] and back[999] == ["", "\u00e9"]
    with pytest.raises(Exception, match="more than 100 entries"):
        vo.encode_tokens(texts, "id", F.col("t"), vocab, most=100).collect()


def test_first_new_row_of_a_key_is_inserted(spark, rows):
    target = spark.createDataFrame([(1, "x", 9)], "id int, name string, stamp int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (2, "c", 3), (2, "d", 3), (3, None, None)], "id int, name string, stamp int")
    assert rows(k.inserted_if_absent(target, new, ["id"], ["stamp"])) == [(2, "c", 3), (3, None, None)]


@pytest.mark.parametrize("rows_per_value", [0, 40])
def test_prefix_sums_are_those_of_one_random_order(monkeypatch, rows_per_value):
    """Every subset of a place's size is equally likely, and a smaller place's rows are among those of a larger one."""
    monkeypatch.setattr(st, "ROWS_PER_VALUE", rows_per_value)
    rng = np.random.default_rng(4)
    values = 2 ** np.arange(6)  # a sum names its rows
    places = np.tile([[2, 4, 3]], (30_000, 1))
    got = st.prefix_sums(rng, values, np.ones(6, np.int64), places, cells=6000)
    for column, place in enumerate((2, 4, 3)):
        seen = collections.Counter(got[:, column].tolist())
        assert all(bin(s).count("1") == place for s in seen) and len(seen) == math.comb(6, place)
        even = len(got) / len(seen)
        assert all(abs(n - even) < 5 * even**0.5 for n in seen.values())
    assert (got[:, 0] & got[:, 2] == got[:, 0]).all() and (got[:, 2] & got[:, 1] == got[:, 2]).all()


def test_permutation_of_uneven_groups(spark):
    """Groups are shuffled once for all partners, however their sizes differ; p-values are those of all permutations."""
    data = {"a": [1, 2, 9], "b": [4, 6, 7, 8, 11, 12], "c": [3]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v int")
    got = {(r["a"], r["b"]): r for r in st.pairwise_permutation(df, "g", "v", rounds=20_000, seed=2, rounds_per_task=6000).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), r in got.items():
        pool, n = data[a] + data[b], len(data[a])
        gaps = [abs(sum(c) / n - (sum(pool) - sum(c)) / (len(pool) - n)) for c in itertools.combinations(pool, n)]
        real = sum(data[a]) / n - sum(data[b]) / len(data[b])
        exact = sum(g >= abs(real) - 1e-9 for g in gaps) / len(gaps)
        assert r["rounds"] == 20_000 and r["difference"] == pytest.approx(real) and r["p_value"] == pytest.approx(exact, abs=0.02)
