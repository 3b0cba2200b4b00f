"""Token ids, their files, and the alignment of two tokenizers, against the libraries on whole texts and plain loops."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from faultline.llm import alignment, queries, simple8b, token_files  # noqa: E402
from faultline.llm.storage import send_package, stored  # noqa: E402
from faultline.llm.tokenizing import byte_level, sentence_pieces  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", " \n", "a  b", "a \n b  ", " a", "x\x1cy", "!\x1d b", "a\u00a0 b", "a\u3000\u3000 b", "日本語 テキスト", "🙂🙂 x",
       "<|endoftext|> <s></s>", "don't  'll 'x", "a\r\n\tb", "\t\tif x:\n\t\t\ty", "café naïve", "▁a b▁", "a\x0b\x0cb", "é\u0301 x",
       "\u200bx \u200b y", "a<0x0A>b", "한국어 текст עברית", "\ufeffword", "x" * 3000, "ab " * 2000, "\u2581"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" \n\t\rab'sé\u00a0\u2003😀1.,!日") for _ in range(rng.randint(0, 60))) for _ in range(3000)]


def test_pieces_give_the_ids_of_whole_texts(texts):
    a, b = byte_level(A), sentence_pieces(B)
    whole = a.model.encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in a.encode([" " + t for t in texts])] == [w.ids for w in whole]
    whole = a.model.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in a.encode(texts)] == [w.ids for w in whole]
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode([" " + t for t in texts])] == b.model.encode(texts, num_threads=1)


def test_pieces_that_come_again_are_learned_once():
    """A full store of pieces lets go of those that came once, not of the common ones; ids stay those of the texts."""
    from faultline.llm.tokenizing import _Pieces

    class Letters(_Pieces):
        def __init__(self, most):
            super().__init__(most)
            self.asked = []

        def cut(self, text):
            return text.split()

        def learn(self, pieces):
            self.asked += pieces
            self.known.update({p: p.encode() for p in pieces})

    model = Letters(10)
    for i in range(20):
        rare = [f"r{i}-{j}" for j in range(4)]
        assert model.encode(["a b c " + " ".join(rare)]) == ["".join(["a", "b", "c", *rare]).encode()]
        assert len(model.known) <= 10 + 7
    assert [model.asked.count(p) for p in "abc"] == [1, 1, 1]


def test_pieces_that_come_again_stay_also_if_they_are_most():
    """Pieces of which more than half come again in every chunk are learned once, however often the store is full."""
    from faultline.llm.tokenizing import _Pieces

    class Letters(_Pieces):
        asked = []

        def cut(self, text):
            return text.split()

        def learn(self, pieces):
            self.asked += pieces
            self.known.update({p: p.encode() for p in pieces})

    model = Letters(10)
    for i in range(20):
        assert model.encode([f"a b c d e f g h r{i} a", "b"]) == [f"abcdefghr{i}a".encode(), b"b"]
        assert len(model.known) + len(model.before) <= 10 + 10
    assert [model.asked.count(p) for p in "abcdefgh"] == [1] * 8


def test_words_and_marks_behind_them_outlive_a_full_store():
    model, small = byte_level(A), type(byte_level(A))(A, 6)
    for i in range(30):
        text = [f"one two, three... four{i}, (five) one, two... {i}, café, é!", f"\n two,, x{i % 3}"]
        assert small.encode(text) == model.encode(text)


@pytest.mark.parametrize("seed", range(8))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([0, 1, 59, 60, 61, 1023, 1024, 1025, 5000, 300_000]))
    values = rng.integers(0, 2**63, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
    if seed % 2:
        values = (values & np.uint64(1)) if seed == 1 else values % np.uint64(50_000)
    coded = simple8b.encode(values)
    assert (simple8b.decode(coded, n) == values).all()
    if n:  # a block decodes alone
        k = len(coded.first) - 1
        last = simple8b.Coded(coded.words[coded.first[k] :], np.zeros(1, np.int64), coded.wide[k:])
        assert (simple8b.decode(last, n - k * simple8b.BLOCK) == values[k * simple8b.BLOCK :]).all()


def test_simple8b_packs_many_small_numbers_in_a_word():
    assert len(simple8b.encode(np.ones(600, np.uint64)).words) == 10
    assert len(simple8b.encode(np.full(4, 32_767, np.uint64)).words) == 1
    assert len(simple8b.encode(np.array([2**60], np.uint64)).words) == 2  # an escape and the number as it is


def test_file_round_trip():
    ids = np.random.default_rng(0).zipf(1.3, 5000).astype(np.uint32) % 70_000
    ids[7] = 2**32 - 1
    lengths = np.array([0, 4000, 1, 999], np.uint64)
    data = token_files.to_bytes([None, -5, 2**40, 3], lengths, ids)
    numbers, known, back, same = token_files.from_bytes(data)
    assert numbers.tolist() == [0, -5, 2**40, 3] and known.tolist() == [False, True, True, True]
    assert back.tolist() == lengths.tolist() and (same == ids).all()
    with pytest.raises(ValueError):
        token_files.from_bytes(data[:-8] + b"")
    none = token_files.from_bytes(token_files.to_bytes([1, 2], np.zeros(2, np.uint64), np.zeros(0, np.uint32)))
    assert none[2].tolist() == [0, 0] and len(none[3]) == 0


@pytest.mark.parametrize("file_ids", [1, 500, 10**6])
def test_written_tokens_come_back_in_order(spark, make_docs, messy_rows, file_ids):
    send_package(spark)
    docs = make_docs(messy_rows)
    files = token_files.write_tokens(docs, A, file_ids=file_ids)
    got = token_files.read_tokens(files).orderBy("start").collect()
    model = byte_level(A).model
    want = Counter((r[0], tuple(model.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in messy_rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    ids = [-(10**9) if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)


def test_rows_that_share_an_id_have_a_fixed_order(spark, make_docs):
    send_package(spark)
    rows = [(1, f"text {i % 7} of one id") for i in range(40)]

    def stream():
        out = token_files.read_tokens(token_files.write_tokens(make_docs(random.sample(rows, len(rows))), A)).orderBy("start").collect()
        return [bytes(r["ids"]) for r in out]

    assert stream() == stream()


def test_no_documents_give_no_files(spark, make_docs):
    files = token_files.write_tokens(make_docs([]), A)
    assert files.count() == 0 and token_files.read_tokens(files).count() == 0


def aligned_plainly(text):
    """Ids of both sides by group, by a loop over end offsets."""
    a, b = byte_level(A), sentence_pieces(B)
    if not text:
        return []
    ids_a = a.model.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.model.encode(text)
    raw = (" " + text).encode()
    if any(m.decode(np.array(ids, np.int64)).tobytes() != raw for m, ids in ((a, ids_a), (b, ids_b))):
        return []
    ends = []
    for model, ids in ((a, ids_a), (b, ids_b)):
        ends.append(np.cumsum(model.lengths[ids]).tolist())
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, i, j = [], 0, 0
    for c in cuts:
        x, y = ends[0].index(c) + 1, ends[1].index(c) + 1
        out.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return out


def plain_alignment(texts):
    groups = [aligned_plainly(t) for t in texts]
    held = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in groups]
    count = Counter(p for h in held for p in h)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    rows = []
    for g, h in zip(groups, held):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        rows.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(h.values()),
                     sum(n for p, n in h.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in h.items()),
                     hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return rows


_ROW = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk_bytes", [50, 1 << 22])
def test_alignment_equals_a_plain_loop(spark, make_docs, messy_rows, texts, chunk_bytes, monkeypatch):
    send_package(spark)
    words = [(i, " ".join(t.split(" ")[:3000]) if t else t) for i, t, *_ in messy_rows]
    rows = words + [(100 + i, t) for i, t in enumerate(texts[:400])]
    from pyspark.sql import functions as F

    docs = alignment.align(make_docs(rows), A, B, chunk_bytes=chunk_bytes)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    got = alignment.scored(stored(docs.select("*", digest).drop("groups"), "aligned"), alignment.pair_bits(A, B)).select("doc_id", *_ROW).collect()
    want = plain_alignment([t for _, t in rows])
    assert Counter((r[0],) + tuple(r)[1:] for r in got) == Counter((i,) + w for (i, _), w in zip(rows, want))


def test_products_of_large_groups_are_whole_and_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    sizes_a, sizes_b = rng.integers(2, 60, 20), rng.integers(2, 60, 20)
    ids_a, ids_b = rng.integers(0, 40, sizes_a.sum()).astype(np.uint32), rng.integers(0, 40, sizes_b.sum()).astype(np.uint32)
    doc = np.sort(rng.integers(0, 4, 20))
    of_a, of_b = np.repeat(np.arange(20), sizes_a), np.repeat(np.arange(20), sizes_b)
    want = Counter()
    for g in range(20):
        for x in ids_a[of_a == g]:
            for y in ids_b[of_b == g]:
                want[int(doc[g]) << 12 | int(x) << 6 | int(y)] += 1
    for most in (1, 100, 10**6):
        monkeypatch.setattr(alignment, "MOST_PRODUCTS", most)
        got = Counter()
        for keys, n in alignment._products(np.arange(20), doc, ids_a, of_a, ids_b, of_b, (6, 6)):
            for k, m in zip(keys.tolist(), n.tolist()):
                got[k] += m
        assert got == want


@pytest.mark.parametrize("lane", [1, 3, 64, 1024])
def test_lockstep_takes_the_path_of_a_merge(lane):
    rng = random.Random(lane)
    for _ in range(40):
        ends, begins = ([], []), [0]
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 5, 50, 3000])
            for e in ends:
                e += sorted(begins[-1] + x for x in {n, *rng.sample(range(1, n + 1), rng.randint(0, n))} if n)
            begins.append(begins[-1] + n)
        path = alignment.lockstep(np.array(ends[0], np.int64), np.array(ends[1], np.int64), np.array(begins), lane)
        i = j = 0
        links = []
        while i < len(ends[0]):
            links.append((i, j))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        assert sorted(zip(path.link_a.tolist(), path.link_b.tolist())) == links
        both = sorted(set(ends[0]) & set(ends[1]))
        assert [e for e, c in zip(ends[0], path.cut_a) if c] == both == [e for e, c in zip(ends[1], path.cut_b) if c]


def test_empty_table_aligns_to_nothing(spark, make_docs):
    out = alignment.align(make_docs([]), A, B)
    assert alignment.scored(stored(out.drop("groups"), "aligned"), alignment.pair_bits(A, B)).count() == 0


def test_queries_on_the_test_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op11_simple8b(spark, sf_dir).collect()}
    model, at = byte_level(A).model, 0
    for i in sorted(docs):
        ids = model.encode(docs[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    keys = sorted(docs)
    found = {r["doc_id"]: r for r in queries.op12_token_alignment(spark, sf_dir).collect()}
    assert {i: tuple(found[i][c] for c in _ROW) for i in found} == dict(zip(keys, plain_alignment([docs[i] for i in keys])))


def test_arrow_types_do_not_matter(spark, texts):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([None, "a b"], pa.large_string())], ["id", "text"])
    tables = alignment._tables(A, B)
    assert alignment._align_chunk(batch, 0, tables).column("n_a").to_pylist() == [0, 2]
