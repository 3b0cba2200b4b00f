"""Runs of words against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import periodic_runs as runs, queries


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, 2 * q):
                found[start, length] = min(q, found.get((start, length), q))
            i = max(i, start + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 3, 12, 13, 40, 90]), rng.choice([1, 2, 2, 3, 5, 30])
            words = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        least = rng.choice([12, 12, 12, 2, 5, 20])
        first = np.append(0, np.cumsum([len(t) for t in texts]))
        names = np.array([w for t in texts for w in t], np.uint64) * np.uint64(77_777) + np.uint64(3)
        got = list(zip(*(x.tolist() for x in runs.runs_of(names, first, least))))
        assert got == [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t, least)]


def test_long_texts_of_one_word_and_of_nested_periods():
    assert [x.tolist() for x in runs.runs_of(np.zeros(50_000, np.uint64), np.array([0, 50_000]))] == [[0], [0], [50_000], [1]]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    got = [x.tolist() for x in runs.runs_of(np.array(b, np.uint64), np.array([0, len(b)]))]
    assert list(zip(*got[1:])) == plain_runs(b)


def test_texts_are_read_byte_for_byte(spark, make_docs, messy_rows):
    mixed = "Aa aa AA aA " * 5
    rows = messy_rows + [(30, "x y z " * 4 + "w"), (31, "x\ty\nz\r" * 4), (32, "X y z x y z x Y z x y z"), (33, mixed), (34, "a " * 11), (35, "a " * 12),
                         (36, "é ü é ü " * 4), (37, "a" * 50_000)]
    got = runs.find_runs(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    want = {}
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        found = plain_runs(words) if len(words) < 5000 else []
        want.setdefault(i, []).append((len(words), found, plain_collapse(words, found).decode()))
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in want.items()}
    assert by_id[35][0][1] == [(0, 12, 1)] and by_id[34][0][1] == [] and by_id[32][0][1] == [] and by_id[33][0][1] == [(0, 20, 4)]


def test_other_least_length_and_rewriting(spark, make_docs):
    docs = make_docs([(1, "a b a b a"), (2, "a b c d e"), (3, None)])
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.find_runs(docs, least=4).collect()}
    assert got == {1: [(0, 5, 2)], 2: [], 3: []}
    first_word = runs.find_runs(docs, least=4, rewrite=lambda i, n: np.zeros(n, np.int64) if i == 2 else None).collect()
    assert {r["doc_id"]: r["collapsed"] for r in first_word} == {1: "a b", 2: "a", 3: ""}
    with pytest.raises(ValueError):
        runs.find_runs(docs, least=1)


def test_no_documents(spark, make_docs):
    assert runs.find_runs(make_docs([])).count() == 0


def test_names_of_words_tell_case_apart():
    from faultline.llm import text as tx

    words = ["Ab", "aB", "ab", "AB", "ABc", "abC", "É", "é", "x" * 70 + "Y", "X" + "x" * 69 + "y"]
    t = tx.tokens(pa.array([" ".join(words + words)]))
    names = runs._exact_names(t)
    assert len(set(names.tolist())) == len(words) and (names[: len(words)] == names[len(words) :]).all()


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_a_plain_search(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r["n_runs"] > 0 for r in got.values()) > 5
    for d in docs:
        words = planted(d["doc_id"], (d["text"] or "").encode().split())
        if len(words) > 4000:
            continue
        found, r = plain_runs(words), got[d["doc_id"]]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, found)).hexdigest()
