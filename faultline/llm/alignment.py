"""Alignment of two tokenizers' tokens by lockstep merging of their byte offsets.

*Lockstep.* A and B tokens of a text are two ascending lists of end offsets over the same bytes. All documents of a chunk
are merged at the same time: numpy vectors hold one A pointer and one B pointer per lane, a step compares all pairs of
ends, emits the pair of tokens as a link, emits a cut where both end, and advances the pointer whose token ends first
(both at a cut). Finished lanes are taken out of the vectors. A lane is a stretch of ``LANE`` bytes of one document,
as the pointers at any offset are known from the lists; so a very long text is many lanes and the number of
steps stays bounded.

*Groups.* Between two cuts lies a group. Its links are all its A with all its B tokens; where one side has a single token
the steps emit just these, elsewhere they are counted as a product of distinct ids.

*Counts.* How many documents hold an id pair linked is added up per chunk first. Each chunk then asks for the totals of its
distinct pairs, so a pair that is in every document is asked for once a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from faultline.llm import text as tx
from faultline.llm.memory import release
from faultline.llm.tokenizing import byte_level, sentence_pieces

CHUNK_BYTES = 1 << 21
PIECES = 250_000  # kept of either vocabulary
LANE = 1024
MOST_PRODUCTS = 1 << 20
_SCHEMA = ("chunk long, place int, id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
           "pairs binary, times binary")


class Path(NamedTuple):
    """Links (A and B token of each step) and, per token, whether it ends at a cut."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lockstep(end_a: np.ndarray, end_b: np.ndarray, texts: np.ndarray, lane: int = LANE) -> Path:
    """Merge the end offsets of all documents of a chunk; ``texts`` are the offsets where documents begin, and the end of
    the last. Offsets go on from document to document."""
    sizes = np.diff(texts)
    n_lanes = np.maximum(1, -(-sizes // lane))
    within = np.arange(int(n_lanes.sum())) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
    starts = np.append(np.repeat(texts[:-1], n_lanes) + within * lane, texts[-1])
    at_a, at_b = np.searchsorted(end_a, starts, "right"), np.searchsorted(end_b, starts, "right")
    a, b, last_a, last_b = at_a[:-1], at_b[:-1], at_a[1:], at_b[1:]
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    far = np.iinfo(np.int64).max
    end_a, end_b = np.append(end_a, far), np.append(end_b, far)  # the pointers behind the last tokens
    link_a, link_b = [], []
    while len(a):
        more = (a < last_a) | (b < last_b)
        if not more.all():
            a, b, last_a, last_b = a[more], b[more], last_a[more], last_b[more]
        ends, others = end_a[a], end_b[b]
        link_a.append(a)
        link_b.append(b)
        both = ends == others
        cut_a[a[both]] = True
        cut_b[b[both]] = True
        a, b = a + (ends <= others), b + (others <= ends)
    none = np.zeros(0, np.int64)
    return Path(np.concatenate(link_a or [none]), np.concatenate(link_b or [none]), cut_a, cut_b)


def _consolidated(keys: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their multiplicities added up."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    sums = np.diff(np.append(new, len(keys))) if times is None else np.add.reduceat(times, new) if len(new) else times
    return keys[new], sums


def _products(group: np.ndarray, doc: np.ndarray, ids_a, of_a, ids_b, of_b, bits: tuple[int, int]) -> Iterator[tuple]:
    """Keys (document, A id, B id) and multiplicities of all links of the groups ``group``, a bounded number at a time."""
    if not len(group):
        return
    key_a, n_a = _consolidated(of_a.astype(np.uint64) << np.uint64(32) | ids_a, None)
    key_b, n_b = _consolidated(of_b.astype(np.uint64) << np.uint64(32) | ids_b, None)
    first_b = np.searchsorted(key_b >> np.uint64(32), group.astype(np.uint64))
    many_b = np.searchsorted(key_b >> np.uint64(32), group.astype(np.uint64), "right") - first_b
    own = np.searchsorted(group, (key_a >> np.uint64(32)).astype(np.int64))  # its group, for every distinct A id of a group
    upto = np.cumsum(many_b[own])
    i = 0
    while i < len(own):
        done = int(upto[i] - many_b[own[i]])
        j = max(i + 1, int(np.searchsorted(upto, done + MOST_PRODUCTS, "right")))
        g, n = own[i:j], many_b[own[i:j]]
        x = np.repeat(np.arange(i, j), n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[g], n)
        low = np.uint64(0xFFFFFFFF)
        key = doc[own[x]].astype(np.uint64) << np.uint64(sum(bits)) | (key_a[x] & low) << np.uint64(bits[1]) | key_b[y] & low
        yield _consolidated(key, n_a[x] * n_b[y])
        i = j


def _strings(ids_a, ids_b, size_a, size_b, doc_of_group, docs: int, names) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    names_a, names_b = names
    groups = len(size_a)
    if not groups:
        return [""] * docs
    size = size_a + size_b
    first = np.cumsum(size) - size
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    place_a = np.arange(len(ids_a)) + np.repeat(first - start_a, size_a)
    place_b = np.arange(len(ids_b)) + np.repeat(first + size_a - start_b, size_b)
    final = np.append(doc_of_group[1:] != doc_of_group[:-1], True)
    # three entries a token: followed by a comma, by the mark that ends its side, by nothing
    kind_a, kind_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    kind_a[start_a + size_a - 1] = 1
    kind_b[start_b + size_b - 1] = np.where(final, 2, 1)
    at = np.empty(len(ids_a) + len(ids_b), np.int64)
    at[place_a] = 3 * ids_a.astype(np.int64) + kind_a
    at[place_b] = len(names_a) + 3 * ids_b.astype(np.int64) + kind_b
    parts = list(map((names_a + names_b).__getitem__, at.tolist()))
    ends = np.cumsum(np.bincount(doc_of_group, size, minlength=docs).astype(np.int64))
    out, i = [], 0
    for j in ends.tolist():
        out.append("".join(parts[i:j]))
        i = j
    return out


def pair_bits(path_a: str, path_b: str) -> tuple[int, int]:
    return tuple(max(1, (len(m.lengths) - 1).bit_length()) for m in (byte_level(path_a, PIECES), sentence_pieces(path_b, PIECES)))


def _pair_type(bits: tuple[int, int]) -> type:
    return np.uint32 if sum(bits) <= 32 else np.uint64


def _faithful(model, ids: list[bytes], texts: list[str]) -> list[bytes | None]:
    """None for texts that their ids do not give back byte for byte."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw])
    every = np.frombuffer(b"".join(ids), "<u4")
    place = np.append(0, np.cumsum(model.lengths[every]))
    same = np.diff(place[np.cumsum([0] + [len(i) // 4 for i in ids])]) == size
    kept = np.frombuffer(b"".join([i for i, s in zip(ids, same) if s]), "<u4")
    wrong = np.flatnonzero(model.decode(kept) != np.frombuffer(b"".join([r for r, s in zip(raw, same) if s]), np.uint8))
    at = np.flatnonzero(same)
    same[at[np.searchsorted(np.cumsum(size[at]), wrong, "right")]] = False
    return [i if s else None for i, s in zip(ids, same)]


def _align_chunk(piece: pa.RecordBatch, number: int, tables) -> pa.RecordBatch:
    (model_a, model_b), (len_a, len_b), names, bits = tables
    docs = piece.num_rows
    texts = [" " + (t or "") for t in piece.column("text").to_pylist()]
    found = [_faithful(m, m.encode(texts), texts) for m in (model_a, model_b)]
    ok = [t != " " and x is not None and y is not None for t, x, y in zip(texts, *found)]
    ids = [[x if good else b"" for x, good in zip(f, ok)] for f in found]
    n_a, n_b = (np.array([len(x) // 4 for x in own], np.int64) for own in ids)
    ids_a, ids_b = (np.frombuffer(b"".join(own), "<u4") for own in ids)
    del texts, found, ids
    end_a, end_b = np.cumsum(len_a[ids_a]), np.cumsum(len_b[ids_b])
    begins = np.append(0, np.append(0, end_a)[np.cumsum(n_a)])
    path = lockstep(end_a, end_b, begins)
    doc_a = np.repeat(np.arange(docs), n_a)
    last_a, last_b = np.flatnonzero(path.cut_a), np.flatnonzero(path.cut_b)
    size_a, size_b = np.diff(np.append(-1, last_a)), np.diff(np.append(-1, last_b))
    doc_of_group = doc_a[last_a]
    simple = (size_a == 1) | (size_b == 1)
    of_a, of_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    kept = simple[of_a[path.link_a]]
    a, b = path.link_a[kept], path.link_b[kept]
    key = doc_a[a].astype(np.uint64) << np.uint64(sum(bits)) | ids_a[a].astype(np.uint64) << np.uint64(bits[1]) | ids_b[b].astype(np.uint64)
    del path, a, b, kept
    keys, times = _consolidated(key, None)
    in_a, in_b = ~simple[of_a], ~simple[of_b]
    for more, n in _products(np.flatnonzero(~simple), doc_of_group[~simple], ids_a[in_a], of_a[in_a], ids_b[in_b], of_b[in_b], bits):
        keys, times = _consolidated(np.append(keys, more), np.append(times, n))
    doc = (keys >> np.uint64(sum(bits))).astype(np.int64)
    pairs = (keys & np.uint64((1 << sum(bits)) - 1)).astype(_pair_type(bits))
    cut = np.searchsorted(doc, np.arange(docs + 1))
    times = times.astype(np.uint32)
    groups = _strings(ids_a, ids_b, size_a, size_b, doc_of_group, docs, names)
    columns = [
        pa.array(np.full(docs, number)), pa.array(np.arange(docs, dtype=np.int32)), piece.column("id"), pa.array(n_a), pa.array(n_b),
        pa.array(np.bincount(doc_of_group, minlength=docs)),
        pa.array(np.bincount(doc_of_group, size_a * size_b, minlength=docs).astype(np.int64)), pa.array(groups, pa.string()),
        pa.array([pairs[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
        pa.array([times[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCHEMA.split(", ")])


def _tables(path_a: str, path_b: str) -> tuple:
    models = byte_level(path_a, PIECES), sentence_pieces(path_b, PIECES)
    lengths = tuple(m.lengths for m in models)
    names = tuple([f"{i}{mark}" for i in range(len(m.lengths)) for mark in marks] for m, marks in zip(models, (",||", (",", ";", ""))))
    return models, lengths, names, pair_bits(path_a, path_b)


def _aligner(path_a: str, path_b: str, chunk_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, number = _tables(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in tx.chunks(batch, "text", chunk_bytes):
                yield _align_chunk(piece, number, tables)
                number += 1
                release()

    return run


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids
    of A and B by group, in order), and for `pair_counts` and `scored` the ``chunk`` and ``place`` it was aligned in and
    its distinct linked id pairs with their multiplicities (``pairs``, ``times``). Store the result before scoring: chunks
    are numbered by task.

    ``path_a`` is a byte-level vocabulary and gets the text behind a space, ``path_b`` a sentence-piece model, which adds
    that space; special tokens' strings are plain text. Texts null or empty, or that either tokenizer does not give back
    byte for byte, have no tokens: zeros and an empty ``groups``. Null ids stay, repeated rows are documents of their own, an
    empty table gives none, other columns are ignored. Texts of any length are aligned whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_aligner(path_a, path_b, chunk_bytes), _SCHEMA).withColumnRenamed("id", id_col)


def _distinct(kind: type) -> Callable:
    """Distinct pairs of a chunk and in how many of its documents each is. Rows of a chunk follow one another, so it is
    complete but where a file is read by two tasks; then it comes in two parts."""

    def rows(chunk: int, cells: list[bytes]) -> pa.RecordBatch:
        pairs, n = np.unique(np.frombuffer(b"".join(cells), kind), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(pairs.astype(np.int64)), pa.array(n)], ["chunk", "pair", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, cells = None, []
        for batch in batches:
            for c, pairs in zip(batch.column("chunk").to_pylist(), batch.column("pairs").to_pylist()):
                if c != chunk and cells:
                    yield rows(chunk, cells)
                    cells = []
                chunk = c
                cells.append(pairs)
        if cells:
            yield rows(chunk, cells)

    return run


def _wanted(aligned: DataFrame, kind: type) -> DataFrame:
    return aligned.select("chunk", "pairs").mapInArrow(_distinct(kind), "chunk long, pair long, docs long")


def pair_counts(aligned: DataFrame, bits: tuple[int, int]) -> DataFrame:
    """``pair`` (A id shifted by ``bits[1]``, and B id), ``a``, ``n`` (documents that hold it linked)."""
    counts = _wanted(aligned, _pair_type(bits)).groupBy("pair").agg(F.sum("docs").alias("n"))
    return counts.select("pair", F.shiftright("pair", bits[1]).cast("int").alias("a"), "n")


def _summed(kind: type) -> Callable:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("pair")
        known, first = np.unique(answers["pair"].to_numpy(), return_index=True)  # twice where a chunk came in parts
        n, best = answers["n"].to_numpy()[first], answers["best"].to_numpy(zero_copy_only=False)[first].astype(np.int64)
        cells = docs["pairs"].to_pylist()
        pairs = np.frombuffer(b"".join(cells), kind).astype(np.int64)
        times = np.frombuffer(b"".join(docs["times"].to_pylist()), np.uint32).astype(np.int64)
        at = np.searchsorted(known, pairs)
        cut = np.cumsum([0] + [len(c) // np.dtype(kind).itemsize for c in cells])

        def sums(values: np.ndarray) -> pa.Array:
            return pa.array(np.diff(np.append(0, np.cumsum(values))[cut]))

        out = docs.drop_columns(["pairs", "times"])
        return out.append_column("n_best", sums(times * best[at])).append_column("count_sum", sums(times * n[at]))

    return run


def scored(aligned: DataFrame, bits: tuple[int, int]) -> DataFrame:
    """The stored result of `align` without its pairs, and per document ``n_best`` (links whose pair is held by as many
    documents as any pair of their A id) and ``count_sum`` (documents that hold the pair, added up over the links).

    The highest count per A id has one row per entry of A's vocabulary at most, which bounds its broadcast."""
    kind = _pair_type(bits)
    counts = pair_counts(aligned, bits)
    top = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("top")))
    marked = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    answers = _wanted(aligned, kind).select("chunk", "pair").join(marked, "pair").select("chunk", "pair", "n", "best")
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    schema = ", ".join([*carried, "n_best long", "count_sum long"])
    return aligned.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_summed(kind), schema)
