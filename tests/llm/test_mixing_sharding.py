"""Apportionment, mixing, sharding and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

import corpus_pipeline
from faultline.llm import mixing, queries, sharding
from faultline.llm.storage import send_package


@pytest.fixture(autouse=True)
def sent(spark):
    send_package(spark)


def plain_seats(weights, seats):
    got = Counter()
    for _ in range(seats):
        got[max(weights, key=lambda k: (Fraction(weights[k]) / (2 * got[k] + 1), [-ord(c) for c in k]))] += 1
    return {k: got[k] for k in weights}


@pytest.mark.parametrize("seed", range(6))
def test_sainte_lague_equals_seat_by_seat(spark, seed):
    rng = random.Random(seed)
    groups = {g: {f"k{i}": rng.choice([0, 1, 5, rng.randrange(1, 10**6)]) for i in range(rng.randrange(1, 9))} for g in "abc"}
    groups = {g: w for g, w in groups.items() if sum(w.values())}
    seats = {g: rng.randrange(0, 200) for g in groups}
    df = spark.createDataFrame([(g, f"{g}{k}", float(w), seats[g]) for g, ws in groups.items() for k, w in ws.items()], "g string, k string, w double, s long")
    got = {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], ["k"], "w", "s").collect()}
    for g, ws in groups.items():
        assert {k: got[f"{g}{k}"] for k in ws} == plain_seats(ws, seats[g])


def plain_targets(words, weights, epochs=1.5, most=2.0):
    order = sorted([s for s in words if s is not None]) + [s for s in words if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), epochs * sum(words.values())
    while True:
        left = total - sum(most * words[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * words[s]}
        if not over:
            return {s: most * words[s] if s in full else share[s] for s in order}
        full |= over


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(2)
    sizes = {"b": 900, "a": 120, None: 60, "c": 40, "é": 200, "Z": 8}
    out, n = [], 0
    for s, many in sizes.items():
        for _ in range(many):
            out.append((n, " ".join("x" for _ in range(rng.choice([0, 1, 7, 40, 300]))), s))
            n += 1
    return out + [(n, None, "a"), (n + 1, "", "a"), (n + 2, "y " * 20_000, "b"), (None, "x y z", "b"), (5, out[5][1], "b"), (5, out[5][1], "b")]


def test_mix_meets_its_targets(make_docs, mixed_rows):
    words = defaultdict(int)
    for _, t, s in mixed_rows:
        words[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(words, (5, 2, 1))
    for shard_words in (4_000_000, 5_000):
        got = mixing.mix_sources(make_docs(mixed_rows), shard_words=shard_words).collect()
        assert len(got) == len(mixed_rows)
        taken, shards = defaultdict(int), sum(words.values()) / shard_words + 1
        for r in got:
            assert 0 <= r.taken <= 2 * r.size and r.source_size == words[r.source]
            assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
            taken[r.source] += r.taken
        for s, t in want.items():
            assert abs(taken[s] - t) <= 64 * (shards + 1)
    again = mixing.mix_sources(make_docs(mixed_rows).repartition(3)).collect()
    first = mixing.mix_sources(make_docs(mixed_rows)).collect()
    assert Counter(again) == Counter(first)


def test_mix_of_nothing(make_docs):
    assert mixing.mix_sources(make_docs([])).collect() == []
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(make_docs([(1, None, "a"), (2, " ", None)])).collect()] == [(0, 0.0, 0)] * 2


def test_shards_hold_every_record_once(make_docs, messy_rows):
    for bucket in (24 << 20, 700):
        got = sharding.shuffle_into_shards(make_docs(messy_rows), 5, bucket_bytes=bucket).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in messy_rows)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(5)) <= 1
    again = sharding.shuffle_into_shards(make_docs(messy_rows).repartition(4), 5, bucket_bytes=700).collect()
    key = lambda rows: Counter((r.doc_id, r.text, r.shard, r.slot) for r in rows)
    assert key(again) == key(got)
    assert sharding.shuffle_into_shards(make_docs([]), 5).collect() == []


def test_order_is_random_and_depends_on_the_seed(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, 8, seed=seed, bucket_bytes=20_000).collect()}
    one, two = place(1), place(2)
    assert sum(one[i] == two[i] for i in one) < 20
    counts = Counter((i * 8 // 4000, s) for i, (s, _) in one.items())  # eighth of the ids x shard, 62.5 each
    assert sum((counts[a, b] - 62.5) ** 2 / 62.5 for a in range(8) for b in range(8)) < 120


@pytest.mark.parametrize("same_text", [True, False])
def test_repeats_scatter_like_other_records(spark, same_text):
    """An id with a third of all rows, a text with null id likewise, and pairs of copies."""
    text = "'t'" if same_text else "concat('t ', id)"
    many = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 2 THEN 100 + id DIV 6 END AS doc_id",
        f"CASE WHEN id % 3 = 2 THEN concat('own ', id DIV 6) ELSE {text} END AS text", "id AS nr")
    rows = sharding.external_shuffle(many, bucket_bytes=4_000).select("rec.*", "place").collect()
    assert sorted(r.nr for r in rows) == list(range(3000)) and sorted(r.place for r in rows) == list(range(3000))
    for of in (7, None):
        tenths = Counter(r.place * 10 // 3000 for r in rows if r.doc_id == of)  # 100 each
        assert sum((tenths[k] - 100) ** 2 / 100 for k in range(10)) < 40
    pairs = defaultdict(list)
    for r in rows:
        if r.doc_id is not None and r.doc_id >= 100:
            pairs[r.doc_id].append(r.place)
    apart = [abs(p[0] - p[1]) for p in pairs.values() if len(p) == 2]
    assert len(apart) > 400 and 850 < sum(apart) / len(apart) < 1150  # a third of 3000
    again = sharding.external_shuffle(many.repartition(7), bucket_bytes=4_000).select("rec.*", "place").collect()
    assert Counter((r.doc_id, r.text, r.place) for r in again) == Counter((r.doc_id, r.text, r.place) for r in rows)


def test_written_shards_are_in_order(spark, make_docs, messy_rows, tmp_path):
    out = sharding.shuffle_into_shards(make_docs(messy_rows), 3)
    sharding.write_shards(out, str(tmp_path / "s"))
    for k in range(3):
        slots = [r.slot for r in spark.read.parquet(str(tmp_path / "s" / f"shard={k}")).collect()]
        assert slots == sorted(slots) == list(range(len(slots)))


def test_shard_query_digest(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op8_external_shuffle(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {r.law for r in got} == {"rows"} and {r.shard for r in got} == set(range(24)) and {r.grown_shard for r in got} == {None}


def test_pipeline_of_the_small_tables(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*corpus_pipeline.COLUMNS, "shard", "slot"]
    rows, docs = out.collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows and all(docs[r.doc_id] == r.text for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and max(Counter(r.doc_id for r in rows).values()) <= 2


def test_stages_take_messy_and_empty_tables(spark, sf_dir, make_docs, messy_rows):
    for docs in (make_docs(messy_rows), make_docs([])):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            rows = docs.collect()
            assert docs.columns[:5] == corpus_pipeline.COLUMNS
        assert (len(rows) > 0) == bool(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
