import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from faultline.llm import bloom, text as tx
from faultline.llm.line_dedup import build_mph, mph_index

SPACE = " \t\n\x0b\x0c\r"
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\t\n\x0b |!", max_size=40)), max_size=8)


def plain_words(t):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


@given(texts)
@settings(max_examples=150, deadline=None)
def test_tokens_are_the_words(values):
    t = tx.tokens(pa.array(values, pa.string()))
    want = [(i, w) for i, v in enumerate(values) for w in plain_words(v)]
    assert t.row.tolist() == [i for i, _ in want]
    seen = {}
    for (_, w), h in zip(want, t.hash.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [bytes(t.data[a:b]).decode().translate({c: c + 32 for c in range(65, 91)}) for a, b in zip(t.start, t.end)] == [w for _, w in want]


@given(texts)
@settings(max_examples=150, deadline=None)
def test_lines_are_the_lines(values):
    found = tx.lines(pa.array(values, pa.string()), 3)
    want = [(i, line) for i, v in enumerate(values) for line in (v or "").split("\n")]
    assert found.row.tolist() == [i for i, _ in want]
    assert [bytes(found.data[a:b]).decode() for a, b in zip(found.start, found.end)] == [line for _, line in want]
    keys = [line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)}) for _, line in want]
    assert found.key.tolist() == [len(k) >= 3 for k in keys]
    for i, k in enumerate(keys):
        for j, other in enumerate(keys):
            if found.key[i] and found.key[j]:
                assert (found.hi[i] == found.hi[j]) == (k == other) == (found.lo[i] == found.lo[j])


def test_hashes_do_not_depend_on_the_slice():
    batch = pa.record_batch({"text": pa.array(["a bc", None, "bc  A", "x" * 5000, ""])})
    whole = tx.tokens(batch.column("text")).hash.tolist()
    parts = [h for part in tx.chunks(batch, "text", 4) for h in tx.tokens(part.column("text")).hash.tolist()]
    assert whole == parts and whole[0] == whole[3] and whole[1] == whole[2]
    assert sum(p.num_rows for p in tx.chunks(batch, "text", 4)) == 5


def test_ngrams_stay_inside_a_row():
    row, word = np.array([0, 0, 0, 1, 1, 2]), np.array([5, 6, 7, 5, 6, 9], np.uint64)
    h, at = tx.ngram_hashes(row, word, 2)
    assert at.tolist() == [0, 1, 3] and h[0] == h[2] != h[1]
    assert len(tx.ngram_hashes(row, word, 7)[0]) == 0


@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
@settings(max_examples=60, deadline=None)
def test_perfect_hash_is_minimal_and_perfect(keys):
    keys = np.array(sorted(keys), np.uint64)
    at = mph_index(keys, *build_mph(keys))
    assert sorted(at.tolist()) == list(range(len(keys)))


def test_bit_table_lets_all_wanted_through(spark):
    ids = list(range(-50, 5000, 7))
    table = bloom.bit_table(spark.createDataFrame([(i,) for i in ids], "i long"), "i", len(ids))
    assert bloom.may_hold(table, np.array(ids)).all()
    assert bloom.may_hold(table, np.arange(10**6, 10**6 + 5000)).mean() < 0.2
    assert not bloom.may_hold(bloom.bit_table(spark.createDataFrame([], "i long"), "i", 0), np.array(ids)).any()
