"""Test-set leaks, URL verdicts, fixity and quality against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import decontaminate, fixity, quality, queries, url_reputation
from faultline.llm.storage import send_package


@pytest.fixture(autouse=True)
def sent(spark):
    send_package(spark)


def plain_alignment(x, y, match=1, mismatch=-1, gap=-1):
    best = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            best[i + 1, j + 1] = max(0, best[i, j] + (match if a == b else mismatch), best[i, j + 1] + gap, best[i + 1, j] + gap)
    return best.max()


def test_alignment_score_and_span():
    rng = np.random.default_rng(2)
    for _ in range(60):
        x, y = rng.integers(0, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(1, 40))
        for costs in ((1, -1, -1), (2, -1, -2)):
            score, a, b = decontaminate.smith_waterman(x, y, *costs)
            assert score == plain_alignment(x, y, *costs) == plain_alignment(x, y[a:b], *costs)
    assert decontaminate.smith_waterman(np.array([1, 2]), np.zeros(0, int)) == (0, 0, 0)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(6)
    items = {i: words(rng, rng.randrange(12, 50)) for i in range(12)}
    docs, want, n = [], set(), 0
    for i, item in items.items():
        for kind in range(4):
            text = list(item)
            if kind == 1:  # every eighth word replaced
                text[3::8] = words(rng, len(text[3::8]))
            if kind == 2:  # words lost and added
                del text[4::9]
                text[2:2] = words(rng, 1)
            if kind == 3:  # a few words of the item are no leak
                text = text[:3]
            docs.append((n, " ".join(words(rng, 40) + text + words(rng, rng.randrange(30)))))
            want |= {(n, i)} if kind < 3 else set()
            n += 1
    docs += [(n + k, " ".join(words(rng, 60) + items[0])) for k in range(300)]  # one item in most documents
    want |= {(n + k, 0) for k in range(300)}
    return items, docs, want


def test_leaks_copied_and_edited(make_docs, spark, leaked, messy_rows):
    items, docs, want = leaked
    table = spark.createDataFrame([(i, " ".join(w).upper(), "x") for i, w in items.items()] + [(None, "w1 w2", "x"), (90, None, "x"), (91, "", "x")], "item_id long, text string, doc_id string")
    frame = make_docs(docs + [(i or 0) and ((i + 10_000), t, s) or (i, t, s) for i, t, s in messy_rows])
    for most in (1_000_000, 100):
        got = decontaminate.leaks(frame, table, most_words=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert all(0.4 <= r.score <= 1 and r.first_word < r.last_word for r in got)
    kept = decontaminate.without_leaks(frame, table)
    assert kept.count() == len(docs) + len(messy_rows) - len({i for i, _ in want})
    assert decontaminate.leaks(frame.limit(0), table).collect() == []
    assert decontaminate.leaks(frame, table.limit(0)).collect() == []


@pytest.mark.parametrize("step", [4, 5, 6])
def test_leaks_of_edited_copies_alone(make_docs, spark, step):
    """No exact copy in the corpus, and copies whose edits leave different n-grams with different counts."""
    rng = random.Random(step)
    items = {i: words(rng, rng.randrange(15, 60)) for i in range(10)}
    docs, want = [], set()
    for i, item in items.items():
        for start in range(step - 1 if i % 2 else 1):
            for _ in range(start + 1):
                text = list(item)
                text[start::step] = [f"x{rng.randrange(10**6)}" for _ in text[start::step]]
                if plain_alignment(np.array(item), np.array(text)) >= 0.4 * len(item):
                    want.add((len(docs), i))
                docs.append((len(docs), " ".join(words(rng, 40) + text + words(rng, 20))))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert len(want) > 15 and {(r.doc_id, r.item_id) for r in decontaminate.leaks(make_docs(docs), table).collect()} == want


@pytest.mark.parametrize("common", [20, 3000])
def test_every_copy_above_the_limit_is_found(make_docs, spark, common):
    """Random insertions, deletions and replacements at many rates, against the alignment of every document with every item.
    With few different words all word pairs are common, so the seeds are not rare either."""
    rng = random.Random(common)
    some = lambda n: [f"w{rng.randrange(common)}" for _ in range(n)]
    items = {i: some(rng.randrange(8, 45)) for i in range(8)}
    docs = []
    for item in items.values():
        for rate in (0.05, 0.15, 0.25, 0.35, 0.5):
            for kinds in ("i", "d", "r", "idr"):
                text = []
                for w in item:
                    kind = rng.choice(kinds) if rng.random() < rate else ""
                    text += {"": [w], "i": [w, f"x{rng.randrange(10**6)}"], "d": [], "r": [f"x{rng.randrange(10**6)}"]}[kind]
                docs.append((len(docs), " ".join(some(10) + text + some(10))))
        foreign = [v for k, w in enumerate(item) for v in ([w, "foreign"] if k % 2 else [w])]  # no three words in a row are left
        docs.append((len(docs), " ".join(foreign)))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = {(d, i) for d, t in docs for i, w in items.items() if plain_alignment(np.array(w), np.array(t.split())) >= 0.4 * len(w)}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(make_docs(docs), table).collect()}
    assert len(want) > 80 and set(got) == want


def test_records_are_dropped_one_by_one(make_docs, spark):
    """Rows without an id, or that share one, are judged by their own text."""
    item = " ".join(f"w{i}" for i in range(20))
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make_docs([(None, item), (None, "clean text"), (5, item), (5, "other clean text"), (6, None), (7, "")])
    for most in (1_000_000, 1):
        kept = decontaminate.without_leaks(docs, table, most_words=most)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(5, "other clean text"), (6, None), (7, ""), (None, "clean text")]
    with pytest.raises(ValueError):
        decontaminate.leaks(docs, table, costs=(3, -1, -1))


def test_short_items_are_sought_whole(make_docs, spark):
    table = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "item_id long, text string")
    got = decontaminate.leaks(make_docs([(1, "x alpha beta y"), (2, "beta alpha"), (3, "GAMMA")]), table, limit=0.9).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (3, 2)]


URLS = [
    (1, "http://Sub.Example.NET/en/a?x#y"), (2, "https://example.net/EN/a"), (3, "https://badexample.net"), (4, "http://a.org/fr/x"), (5, "http://org/fr/"),
    (6, "no scheme.net/"), (7, None), (8, ""), (9, "x://example.com/de/1://b"), (10, "http://EXAMPLE.com?a/de/"), (11, "ftp://h.example.com#/de/"),
    (None, "http://x.org/"), (12, "http://ÄX.org/fr/"), (12, "http://ÄX.org/fr/"), (13, "://"),
]


def plain_url(u):
    low = {c: c + 32 for c in range(65, 91)}
    if u is None or "://" not in u:
        host = path = ""
    else:
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(low), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in url_reputation.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.site), default=None)
    return host, path, rule and rule.site, rule and rule.verdict


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(*r, 0, "z") for r in URLS], "page_id long, url string, host int, verdict string")
    labels = spark.createDataFrame([(1, 1, 0), (9, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        got = url_reputation.filter_urls(pages, own).collect()
        assert len(got) == len(URLS)
        want = sorted([(i, *plain_url(u)[:3]) for i, u in URLS], key=repr)
        assert sorted([(r.page_id, r.host, r.path, r.rule) for r in got], key=repr) == want
        rules = {i: plain_url(u)[3] for i, u in URLS}
        assert all(r.verdict == rules[r.page_id] for r in got if rules[r.page_id])
    assert url_reputation.filter_urls(pages.limit(0), labels).collect() == []


def test_reputation_blocks_hosts_with_evidence(spark):
    pages, labels, n = [], [], 0
    for host, share, many in (("good.a.com", 0.02, 200), ("bad.a.com", 0.9, 200), ("new.a.com", 0.0, 3), ("worse.b.co.uk", 0.8, 60), ("fine.c.co.uk", 0.0, 60)):
        for k in range(many):
            pages.append((n, f"http://{host}/p{k}"))
            if host != "new.a.com":
                labels.append((n, int(k >= share * many), 0))
            n += 1
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.host, r.verdict) for r in url_reputation.filter_urls(*frames, long_suffixes=["co.uk"]).collect()}
    assert got == {("good.a.com", "allow"), ("bad.a.com", "block"), ("new.a.com", "allow"), ("worse.b.co.uk", "block"), ("fine.c.co.uk", "allow")}
    suffix = url_reputation.suffix_of(F.col("h"), ["co.uk"])
    parts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("b.co.uk",), ("x.y.com",), ("com",), ("",)], "h string")
    assert [tuple(r) for r in parts.select(suffix, url_reputation.domain_of(F.col("h"), suffix)).collect()] == [
        ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("co.uk", "b.co.uk"), ("com", "y.com"), ("com", "com"), ("", "")
    ]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, file string")


def test_fixity_locates_damage(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (1 + i % 50)) for i in range(700)] + [(None, None, None), (701, None, ""), (702, "u", None)]
    records = fixity.record_table(pages_of(spark, rows), per_file=100)
    other = [(i, u, ("<P" + h[2:]) if i in (5, 333) else h) for i, u, h in rows if i not in (77, 650)] + [(699, "extra", "more"), (803, "new", "page")]
    found = fixity.audit(records, fixity.record_table(pages_of(spark, other), per_file=100), leaf_bytes=512, fanout=4, levels=3).collect()
    assert sorted((r.record_id, r.fault) for r in found) == [(5, "changed"), (77, "missing"), (333, "changed"), (650, "missing"), (699, "extra"), (803, "extra")]
    assert {r.file for r in found} == {0, 3, 6, 8}
    assert fixity.audit(records, records, leaf_bytes=512).collect() == []
    none = records.limit(0)
    assert fixity.audit(none, none).collect() == []
    assert fixity.audit(records, none).count() == 703


def test_second_replica_differs_in_bytes(spark):
    rows = [(7, "u", "<p>"), (108, "u", "éa"), (209, "u", "x"), (310, "u", ""), (411, "", None), (13, "u", "gone"), (8, "u", "kept")]
    other = {r.page_id: (r.url, r.html) for r in queries.damaged(pages_of(spark, rows)).collect()}
    assert set(other) == {i for i, _, _ in rows} - {13} and other[8] == ("u", "kept")
    for i, u, h in rows[:4]:
        assert other[i] != (u, h) and [len(t.encode()) for t in other[i]] == [len(u.encode()), len(h.encode())]
    assert other[411] == ("", "x")


def test_null_ids_get_files_of_bounded_size(spark):
    rows = [(None, "u", "same")] * 400 + [(None, "u", f"own {i}") for i in range(400)] + [(i, "u", "h") for i in range(50)]
    records = fixity.record_table(pages_of(spark, rows), per_file=20)
    assert records.count() == len(rows)
    sizes = [r["count"] for r in records.filter("record_id is null").groupBy("file").count().collect()]
    assert sum(sizes) == 800 and max(sizes) <= 160
    again = fixity.record_table(pages_of(spark, rows[::-1]).repartition(5), per_file=20)
    assert sorted(records.collect(), key=repr) == sorted(again.collect(), key=repr)


def test_only_differing_ranges_are_opened(spark):
    rows = [(i, f"http://h/{i}", "x" * 300) for i in range(500)]
    records = fixity.record_table(pages_of(spark, rows), per_file=500)
    flipped = records.withColumn("digest", F.when(F.col("record_id") == 250, F.lit("?")).otherwise(F.col("digest")))
    got = fixity.audit(records, flipped, leaf_bytes=2048, fanout=4, levels=4).collect()
    assert [(r.record_id, r.fault, r.nodes_differing) for r in got] == [(250, "changed", 1)]
    tree = fixity.merkle_tree(records, 2048, 4, 4)
    sizes = [t.count() for t in tree]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 1


def test_quality_on_held_out_rows(spark, make_docs, messy_rows):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice("the cat sat on a mat and saw some birds fly".split()) for _ in range(60))) for i in range(100, 400)]
    bad = [(i, " | ".join(rng.choice("BUY NOW!! cheap%% $$$ deal CLICK".split()) for _ in range(60))) for i in range(400, 700)]
    docs = make_docs(good + bad + messy_rows)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 0), (100, None), (5, 7)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(good) + len(bad) + len(messy_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    unseen = [r for r in got if r.held_out and (r.doc_id or 0) >= 100]
    assert len(unseen) > 60 and np.mean([r.predicted == int(r.doc_id < 400) for r in unseen]) > 0.97
    again = {r.doc_id: r.score for r in quality.quality_scores(docs.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got if r.doc_id and r.doc_id >= 100)
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    assert len({round(r.score, 9) for r in quality.quality_scores(docs, labels.limit(0)).collect()}) == 1


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0] + 1))).astype(float)
    net = quality.train(x[:3000], y[:3000], epochs=20)
    p = net.scores(x[3000:])
    assert abs(p.mean() - y[3000:].mean()) < 0.04 and 0.25 <= net.temperature <= 8
    for low, high in ((0, 0.2), (0.2, 0.5), (0.5, 0.8), (0.8, 1)):
        inside = (p >= low) & (p < high)
        assert abs(p[inside].mean() - y[3000:][inside].mean()) < 0.1


def test_shapes_and_words_have_rows_of_their_own():
    import pyarrow as pa

    row, word, shape = quality._streams(pa.array(["THE the The!! a1 b22", None, "x"]))
    assert row.tolist() == [0, 0, 0, 0, 0, 2]
    assert word[0] == word[1] and len({*shape[:3]}) == 3 and shape[3] == shape[4] and shape[1] == shape[5]
    assert (word < quality.VOCABULARY // 2).all() and (shape >= quality.VOCABULARY // 2).all()


@pytest.mark.parametrize("name", ["op4_url_reputation", "op5_warc_fixity", "op2_line_dedup"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = getattr(queries, name)(spark, sf_dir)
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    same = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert same(df.collect()) == same([tuple(r[i] for i in at) for r in rel.fetchall()])


def test_texts_are_scored_within_their_records(spark):
    """A text of a record is not sent a second time; other types, and names in other case, go as a column of their own."""
    net = quality.train(np.random.default_rng(1).normal(size=(200, 2 * quality.WIDTH + 1)), np.arange(200) % 2)
    model = quality.QualityModel(np.random.default_rng(2).normal(size=(quality.VOCABULARY, quality.WIDTH)).astype(np.float32), net)
    data = [(i, None if i % 7 == 0 else f"Word{i} and é{i}!! " * (i % 5)) for i in range(60)]
    docs = spark.createDataFrame(data, "id long, text string").repartition(3)
    got = {r.rec.id: (r.rec.text, r.score) for r in model.score(docs).collect()}
    apart = {r.rec.id: (r.rec.text, r.score) for r in model.score(docs.withColumn("TEXT2", F.col("text")), "text2").collect()}
    assert got == apart and {i: t for i, (t, _) in got.items()} == dict(data)
    assert len(model.score(docs.select("id", F.encode("text", "utf-8").alias("text"))).collect()) == 60
    assert model.score(docs)._jdf.queryExecution().analyzed().children().head().output().size() == 1


def test_scoring_takes_little_memory_at_a_time():
    import tracemalloc

    import pyarrow as pa

    net = quality.train(np.zeros((0, 1)), np.zeros(0))
    net.mean, net.scale, net.w1 = np.zeros(65), np.ones(65), np.zeros((65, 1))
    rec = pa.StructArray.from_arrays([pa.array(range(2000)), pa.array(["some words in a text " * 100] * 2000)], ["id", "text"])
    tracemalloc.start()
    try:
        batches = iter([pa.RecordBatch.from_arrays([rec], ["rec"])])
        out = sum(b.num_rows for b in quality._scored(np.ones((quality.VOCABULARY, quality.WIDTH), np.float32), net, 1)(batches))
        assert out == 2000 and tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
