"""Lines, shingle sets and vectors against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import embedding_dedup, line_dedup, rtree_join
from faultline.llm.components import connected_components
from faultline.llm.storage import send_package

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(autouse=True)
def sent(spark):
    send_package(spark)


def plain_lines(rows, least=10):
    def key(line):
        return line.strip(SPACE).translate(LOWER)

    docs = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                docs[key(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(docs.get(key(x), ())) < 2 or min(docs[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("options", [{}, {"hot_keys": 0, "shard_keys": 3}, {"hot_keys": 1, "shard_keys": 5}])
def test_line_dedup_equals_brute_force(make_docs, messy_rows, rows, options):
    got = rows(line_dedup.dedup_lines(make_docs(messy_rows), **options))
    assert got == sorted(plain_lines(messy_rows), key=repr)


def test_line_dedup_of_nothing(make_docs):
    assert line_dedup.dedup_lines(make_docs([])).collect() == []


def test_a_line_of_all_documents_stays_in_the_first(make_docs):
    text = [(i, f"the very same line\nown line number {i:05d}") for i in range(300)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make_docs(text), shard_keys=40).collect()}
    assert sum(r.n_dropped for r in got.values()) == 299 and got[0].n_dropped == 0
    assert got[7].kept_text == "own line number 00007"


def plain_components(nodes, links):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)],
    [(random.Random(5).randrange(200), random.Random(i).randrange(200)) for i in range(150)], [(5, 3), (3, 5), (9, 9), (None, 4)],
])
def test_components(spark, links):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links or [(1, 1)], "x long, y long"), "x", "y").collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == plain_components({n for e in real for n in e}, real)


def shingles(t):
    w = [x.translate(LOWER) for x in (t or "").encode().split() and [b.decode() for b in (t or "").encode().split()]]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_near(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    uf = list(range(len(rows)))

    def root(x):
        while uf[x] != x:
            x = uf[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                uf[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted([(i, len(s), None if i is None else least[root(a)]) for a, (i, s) in enumerate(sets)], key=repr)


@pytest.mark.parametrize("options", [{}, {"often": 1, "bucket_entries": 50}, {"often": 2, "most_frequent": 3}])
def test_jaccard_join_of_messy_rows(make_docs, messy_rows, rows, options):
    got = rows(rtree_join.jaccard_components(make_docs(messy_rows), **options))
    assert got == plain_near(messy_rows)


def test_jaccard_join_finds_all_links_of_families(make_docs, rows):
    """Chains of edits around the threshold, families with a common passage, and one large family."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    data, n = [], 0
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 30, 120, 400]))]
        for copy in range(60 if family == 3 else 6):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if family % 2:
                at = rng.randrange(len(text))
                text[at:at] = passage
            data.append((n, " ".join(text)))
            n += 1
    for _ in range(40):
        data.append((n, " ".join(passage + [rng.choice(words) for _ in range(25)])))
        n += 1
    want = plain_near(data)
    assert len({c for _, _, c in want}) < len(data) - 20
    for often in (4, 32):
        assert rows(rtree_join.jaccard_components(make_docs(data), often=often)) == want


def test_links_inside_families_are_all_given(make_docs):
    """Edited copies that all link through a centre, one family larger than a leaf, equal sets, odd rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    data = [(9000, None), (9001, ""), (None, "w1 w2 w3 w4 w5 w6")]
    for family in range(5):
        base = [rng.choice(words) for _ in range(rng.choice([40, 90]))]
        for _ in range(80 if family == 3 else 8):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            data += [(len(data), " ".join(text))] * rng.choice([1, 1, 2])
    own = [(i, s) for i, t in data if i is not None and (s := shingles(t or ""))]
    want, within = Counter(), 0
    for k, (i, x) in enumerate(own):
        for j, y in own[:k]:
            if 100 * len(x & y) >= 80 * len(x | y):
                within += x == y
                if x != y:
                    want[min(i, j), max(i, j)] += 1
    for options in ({}, {"often": 4, "bucket_entries": 500}):
        links, members = rtree_join.jaccard_links(make_docs(data), **options)
        of = defaultdict(list)
        for r in members.collect():
            of[r.set].append(r.doc_id)
        got = Counter()
        for r in links.collect():
            assert (len(of[r.a]), len(of[r.b]), min(of[r.a]), min(of[r.b])) == (r.copies_a, r.copies_b, r.rep_a, r.rep_b)
            got.update((min(i, j), max(i, j)) for i in of[r.a] for j in of[r.b])
        assert got == want
        assert rtree_join.link_count(links, members).first().n_links == sum(want.values()) + within
    links, members = rtree_join.jaccard_links(make_docs([]))
    assert rtree_join.link_count(links, members).first().n_links == 0


def test_jaccard_join_of_nothing(make_docs):
    assert rtree_join.jaccard_components(make_docs([])).collect() == []


def test_point_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 5000):
        x, y = np.unique(rng.integers(0, 4 * n, n)).astype(np.uint64), np.unique(rng.integers(0, 4 * n, n)).astype(np.uint64)
        for groups in (16, 128):
            bound = np.minimum(rtree_join.point_of(x, groups), rtree_join.point_of(y, groups)).sum()
            assert bound >= len(np.intersect1d(x, y))


def test_box_counts_of_very_long_texts_are_whole():
    """A sum of saturated counts would be below the overlap of equal sets."""
    text = " ".join(map(str, range(1_300_000)))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
    [got] = rtree_join._sets_of(1)(iter([batch]))
    assert sum(got["coarse"][0].as_py()) == got["n"][0].as_py() == 1_300_000


def vectors(seed=4, dim=16):
    rng = np.random.default_rng(seed)
    out, n = [], 0
    for family in range(25):
        base = rng.standard_normal(dim)
        for _ in range(120 if family == 2 else 4):
            out.append((n, (base + rng.standard_normal(dim) * rng.choice([0, 0.02, 0.07, 0.15])).tolist()))
            n += 1
    return out


def test_near_duplicate_vectors_equal_brute_force(spark):
    data = vectors()
    x = np.array([v for _, v in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    want = plain_components(range(len(data)), np.argwhere(linked).tolist())
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    for block in (16, 512):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert len(got) == len(data)
        found = sum(r.n_links for r in got.values())
        assert 0.99 * linked.sum() <= found <= linked.sum()
        assert all(r.n_links <= linked[i].sum() for i, r in got.items())
        assert np.mean([got[i].component_id == want[i] for i in got]) > 0.98
        assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, nan]), (4, [inf, 0.0]), (5, [0.0, 0.0]), (6, None), (7, []),
            (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (10, [1e-30, 0.0]), (11, [1e30, 0.0]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in data] + [(None, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, n_links int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    want = Counter([(1, 3, 1, True), (2, 3, 1, False), (10, 3, 1, False), (11, 3, 1, False), (2, 0, 2, True), (None, 0, None, True)]
                   + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 12)])
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_kept_hash_matches_the_text(spark, sf_dir):
    from faultline.llm import queries

    got = {r.doc_id: r.kept_sha256 for r in queries.op2_line_dedup(spark, sf_dir).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in plain_lines(docs)}
