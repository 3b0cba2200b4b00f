"""Line deduplication by probing sharded minimal perfect hash tables.

1. Every batch of documents gives its distinct line hashes with a count and the first and last document; these are
   summed by Spark, so a line of a third of all documents moves once per batch.
2. The distinct hashes are cut into shards of bounded size. Each shard builds a minimal perfect hash (levels of bit
   arrays) that indexes compact arrays: 32-bit fingerprints, counts, and first documents.
3. Documents send the 64-bit hashes of their lines, packed per shard, to the arrays; only lines to be dropped come
   back. The heaviest keys (a bounded table) are not sent, every task has them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm import text as tx
from faultline.llm.storage import stored

_ARRAYS = "shard int, sizes binary, bits binary, left binary, prints binary, counts binary, owners binary"
_HITS = "id long, hi long"


def build_mph(keys: np.ndarray, gamma: float = 2.0, levels: int = 24) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Minimal perfect hash of distinct 64-bit keys: level sizes, bit array per level, keys that never stood alone
    (looked up in a sorted list; in practice none)."""
    sizes, bits = [], []
    for level in range(levels):
        if not len(keys):
            break
        m = max(64, int(gamma * len(keys)))
        at = (tx.seeded(level, keys) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        bits.append(np.packbits(alone))
        keys = keys[~alone[at]]
    return sizes, bits, np.sort(keys)


def mph_index(keys: np.ndarray, sizes: list[int], bits: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Index of each key; -1 if no level holds it. A key that was not put in may get any index."""
    out = np.full(len(keys), -1, np.int64)
    todo, base = np.arange(len(keys)), 0
    for level, (m, packed) in enumerate(zip(sizes, bits)):
        flags = np.unpackbits(packed)[:m]
        rank = np.cumsum(flags, dtype=np.int64) - 1
        at = (tx.seeded(level, keys[todo]) % np.uint64(m)).astype(np.int64)
        here = flags[at] == 1
        out[todo[here]] = base + rank[at[here]]
        base += int(rank[-1]) + 1
        todo = todo[~here]
    if len(left) and len(todo):
        at = np.minimum(np.searchsorted(left, keys[todo]), len(left) - 1)
        here = left[at] == keys[todo]
        out[todo[here]] = base + at[here]
    return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by ``keys`` (first key first) and where each distinct key begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _keys_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                found = tx.lines(part.column("text"), least)
                known = np.asarray(part.column("id").is_valid())
                ids = part.column("id").fill_null(0).to_numpy(zero_copy_only=False)
                keep = found.key & known[found.row]
                hi, lo, doc = found.hi[keep], found.lo[keep], ids[found.row[keep]]
                order, first = _runs(hi, lo)
                if len(first):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hi[order][first].view(np.int64)),
                            pa.array(lo[order][first].view(np.int64)),
                            pa.array(np.diff(np.append(first, len(order)))),
                            pa.array(np.minimum.reduceat(doc[order], first)),
                            pa.array(np.maximum.reduceat(doc[order], first)),
                        ],
                        ["hi", "lo", "n", "first", "last"],
                    )

    return run


def _built(table: pa.Table) -> pa.Table:
    hi = table["hi"].to_numpy().view(np.uint64)
    lo = table["lo"].to_numpy().view(np.uint64)
    order = np.argsort(hi, kind="stable")
    hi, lo = hi[order], lo[order]
    n, first, last = (table[c].to_numpy()[order] for c in ("n", "first", "last"))
    # one slot per 64-bit hash; two lines that share it are told apart by the fingerprint of the shared one, kept first
    shared = first < last
    rank = np.lexsort((~shared, hi))
    hi, lo, n, first, shared = hi[rank], lo[rank], n[rank], first[rank], shared[rank]
    one = np.append(True, hi[1:] != hi[:-1])
    hi, lo, n, first, shared = hi[one], lo[one], n[one], first[one], shared[one]
    sizes, bits, left = build_mph(hi)
    at = mph_index(hi, sizes, bits, left)
    prints, counts, owners = np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.int32), np.zeros(len(hi), np.int64)
    prints[at] = (lo & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    counts[at] = np.where(shared, np.minimum(n, 2**31 - 1), 0)  # 0: in one document only
    owners[at] = first
    row = [table["shard"][0].as_py(), np.array(sizes, np.int64).tobytes(), b"".join(b.tobytes() for b in bits),
           left.tobytes(), prints.tobytes(), counts.tobytes(), owners.tobytes()]
    names = "shard sizes bits left prints counts owners".split()
    return pa.table([pa.array([v], pa.int32() if k == "shard" else pa.binary()) for k, v in zip(names, row)], names)


def _probes_of(least: int, shards: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                found = tx.lines(part.column("text"), least)
                known = np.asarray(part.column("id").is_valid())
                ids = part.column("id").fill_null(0).to_numpy(zero_copy_only=False)
                keep = found.key & known[found.row] & ~np.isin(found.hi, hot)
                hi, lo, doc = found.hi[keep], found.lo[keep], ids[found.row[keep]]
                shard = (hi % np.uint64(shards)).astype(np.int32)
                order, first = _runs(shard, hi, doc)
                order = order[first]
                shard, hi, lo, doc = shard[order], hi[order], lo[order], doc[order]
                cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, int)
                ends = np.append(cut[1:], len(shard))
                if len(cut):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard[cut]),
                            pa.array([doc[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                            pa.array([hi[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                            pa.array([lo[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, ends)], pa.binary()),
                        ],
                        ["shard", "ids", "his", "los"],
                    )

    return run


def _hits(arrays: pa.Table, probes: pa.Table) -> pa.Table:
    if not arrays.num_rows or not probes.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "hi": pa.array([], pa.int64())})
    one = arrays.slice(0, 1).to_pylist()[0]
    sizes = np.frombuffer(one["sizes"], np.int64).tolist()
    packed, bits, at = np.frombuffer(one["bits"], np.uint8), [], 0
    for m in sizes:
        bits.append(packed[at : at + (m + 7) // 8])
        at += (m + 7) // 8
    doc = np.frombuffer(b"".join(probes["ids"].to_pylist()), np.int64)
    hi = np.frombuffer(b"".join(probes["his"].to_pylist()), np.uint64)
    lo = np.frombuffer(b"".join(probes["los"].to_pylist()), np.uint32)
    at = mph_index(hi, sizes, bits, np.frombuffer(one["left"], np.uint64))
    prints, counts, owners = (
        np.frombuffer(one[c], k) for c, k in (("prints", np.uint32), ("counts", np.int32), ("owners", np.int64))
    )
    drop = (at >= 0) & (prints[at] == lo) & (counts[at] > 0) & (owners[at] != doc)
    return pa.table({"id": pa.array(doc[drop]), "hi": pa.array(hi[drop].view(np.int64))})


def _kept_of(least: int, hot: np.ndarray, hot_owner: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                found = tx.lines(part.column("text"), least)
                known = np.asarray(part.column("id").is_valid())
                ids = part.column("id").fill_null(0).to_numpy(zero_copy_only=False)
                gone = np.zeros(len(found.row), bool)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, found.hi), len(hot) - 1)
                    gone = found.key & (hot[at] == found.hi) & (hot_owner[at] != ids[found.row]) & known[found.row]
                first = np.searchsorted(found.row, np.arange(part.num_rows + 1))
                hits = part.column("hits")
                for i in np.flatnonzero(np.asarray(hits.is_valid())):
                    a, b = first[i], first[i + 1]
                    own = np.array(hits[int(i)].as_py(), np.int64).view(np.uint64)
                    gone[a:b] |= found.key[a:b] & np.isin(found.hi[a:b], own)
                raw, texts = found.data.tobytes(), []
                dropped = np.bincount(found.row[gone], minlength=part.num_rows)
                for i in range(part.num_rows):
                    a, b = first[i], first[i + 1]
                    if dropped[i]:
                        stay = np.flatnonzero(~gone[a:b]) + a
                        texts.append(b"\n".join(raw[found.start[k] : found.end[k]] for k in stay))
                    else:
                        texts.append(raw[found.start[a] : found.end[b - 1]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(first)), pa.array(dropped.astype(np.int64)),
                     pa.array(texts, pa.binary()).cast(pa.string())],
                    ["id", "n_lines", "n_dropped", "kept_text"],
                )

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, shard_keys: int = 200_000,
    hot_keys: int = 1024,
) -> DataFrame:
    """Drop repeated lines: one row per input row with ``id_col``, ``n_lines``, ``n_dropped``, ``kept_text``.

    A line is what stands between line feeds; its key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with
    A-Z lower-cased. Keys of at least ``least`` code points that stand in two documents or more lose all their lines,
    except in the smallest id that holds them. Kept lines are joined by line feeds, as they were written.

    Defined cases: a null or empty text is one empty line. Rows that share an id are one document (a key repeated only
    there stays). Rows with a null id take no part: they keep all lines and protect none. An empty table gives an empty
    result. Other columns of ``docs`` are ignored, whatever their names.
    ``shard_keys`` bounds the keys of a shard, ``hot_keys`` the table of the most frequent shared keys that every task
    gets; neither changes the result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = stored(
        base.mapInArrow(_keys_of(least), "hi long, lo long, n long, first long, last long")
        .groupBy("hi", "lo")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")),
        "line-keys",
    )
    shards = max(1, math.ceil(keys.count() / shard_keys))
    frequent = (
        keys.filter("first < last").orderBy(F.desc("n"), "hi", "lo").limit(hot_keys).select("hi", "first").collect()
    )
    hot = np.array([r["hi"] for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, hot_owner = hot[order], np.array([r["first"] for r in frequent], np.int64)[order]
    signed = F.expr("cast(hi as decimal(20,0)) + if(hi < 0, 18446744073709551616, 0)")  # as unsigned
    arrays = (
        keys.withColumn("shard", F.pmod(signed, F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_built, _ARRAYS)
    )
    probes = base.mapInArrow(_probes_of(least, shards, hot), "shard int, ids binary, his binary, los binary")
    hits = arrays.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(_hits, _HITS)
    per_doc = hits.groupBy("id").agg(F.collect_set("hi").alias("hits"))
    return (
        base.join(per_doc, "id", "left")
        .mapInArrow(_kept_of(least, hot, hot_owner), "id long, n_lines long, n_dropped long, kept_text string")
        .withColumnRenamed("id", id_col)
    )
