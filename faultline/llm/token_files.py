"""Token ids of documents in binary files, in the order of the documents' ids, and back.

*File.* All numbers little-endian; parts in this order::

    magic        8 bytes "S8BTOK1\\n"
    head         6 x uint64: documents, ids, distinct ids, blocks, words, words of the document table
    doc_id       documents x int64, then documents x uint8 (1: the id is known)
    lengths      ids per document, Simple-8b: blocks x (uint64 first word, uint64 wide numbers), words
    ranks        distinct ids x uint32: the ids by falling frequency in the file, ties by id
    blocks       blocks x (uint64 first word, uint64 wide numbers)
    words        words x uint64: rank of every id, Simple-8b in blocks of 1024

An id is stored as its rank in the file, so frequent ids are narrow and share a word with many others.

*Writing.* Documents are range-partitioned by id, so the tasks' files are one ordered stream. Every attempt of a task
writes files under names of its own; the table of files (written by Spark, which keeps the rows of one attempt only)
says which count. Files go through ``pyarrow.fs`` to the folder that all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from faultline.llm import simple8b, text as tx
from faultline.llm.storage import stored
from faultline.llm.tokenizing import byte_level
from faultline.session import shared_folder

MAGIC = b"S8BTOK1\n"
FILE_IDS = 3_000_000
RESULT_IDS = 500_000
_MANIFEST = "part long, seq long, path string, n_docs long, n_ids long, n_bytes long"


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids by falling frequency, and the rank of every id."""
    if len(ids) and ids.max() >= 1 << 22:
        distinct, at, count = np.unique(ids, return_inverse=True, return_counts=True)
    else:  # a vocabulary's ids are places of a table
        every = np.bincount(ids)
        distinct, at = np.flatnonzero(every), ids
        count = every[distinct]
    order = np.argsort(-count, kind="stable")
    rank = np.zeros(len(distinct) if at is not ids else len(every), np.uint64)
    rank[order if at is not ids else distinct[order]] = np.arange(len(order), dtype=np.uint64)
    return distinct[order], rank[at]


def to_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of documents whose ids (uint32) follow one another."""
    known = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], "<i8")
    distinct, codes = _ranked(ids)
    body, sizes = simple8b.encode(codes), simple8b.encode(lengths)
    head = np.array([len(doc_ids), len(ids), len(distinct), len(body.first), len(body.words), len(sizes.words)], "<u8")

    def table(c: simple8b.Coded) -> bytes:
        return np.stack([c.first, c.wide], 1).astype("<u8").tobytes()

    return b"".join([MAGIC, head.tobytes(), numbers.tobytes(), known.tobytes(), table(sizes), sizes.words.astype("<u8").tobytes(),
                     distinct.astype("<u4").tobytes(), table(body), body.words.astype("<u8").tobytes()])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, whether each is known, ids per document, and all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_distinct, n_blocks, n_words, n_size_words = (int(x) for x in np.frombuffer(data, "<u8", 6, 8))
    at = 56

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    def table(n: int) -> tuple[np.ndarray, np.ndarray]:
        both = take("<u8", 2 * n).reshape(-1, 2).astype(np.int64)
        return both[:, 0], both[:, 1]

    numbers, known = take("<i8", n_docs), take("u1", n_docs)
    first, wide = table(-(-n_docs // simple8b.BLOCK))
    lengths = simple8b.decode(simple8b.Coded(take("<u8", n_size_words), first, wide), n_docs).astype(np.int64)
    by_rank = take("<u4", n_distinct)
    first, wide = table(n_blocks)
    ranks = simple8b.decode(simple8b.Coded(take("<u8", n_words), first, wide), n_ids)
    if at != len(data) or int(lengths.sum()) != n_ids:
        raise ValueError("token file is cut off")
    return numbers, known.astype(bool), lengths, by_rank[ranks.astype(np.int64)]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _writer(folder: str, tokenizer: str, end: int | None, file_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), [c.split()[0] for c in _MANIFEST.split(", ")]
        model, mark = byte_level(tokenizer), b"" if end is None else np.array([end], "<u4").tobytes()
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        held_ids, held, n, seq = [], [], 0, 0

        def write() -> pa.RecordBatch:
            data = to_bytes(held_ids, np.array([len(x) // 4 for x in held], np.uint64), np.frombuffer(b"".join(held), "<u4"))
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.s8b"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            row = [part, seq, f"{folder}/{name}", len(held), n, len(data)]
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, row)})

        for batch in batches:
            for piece in tx.chunks(batch, "text"):
                found = model.encode([t or "" for t in piece.column("text").to_pylist()])
                for i, ids in zip(piece.column("id").to_pylist(), found):
                    held_ids.append(i)
                    held.append(ids + mark)
                    n += len(held[-1]) // 4
                    if n >= file_ids:
                        yield write()
                        held_ids, held, n, seq = [], [], 0, seq + 1
        if held:
            yield write()

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 2, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every whole text, append the id ``end``, and write files in ascending order of ``id_col`` (null ids first;
    rows that share an id by their text's hash). Returns the table of files: ``path``, ``start`` (ids in the files before
    it), ``n_docs``, ``n_ids``, ``n_bytes``, in the order of ``part`` and ``seq``.

    Defined cases: null and empty texts have the end id alone. Repeated rows are written each; equal rows in any order, so
    a row that owns a third of the table is dealt to many tasks. A text of any length stands in one file. An empty
    table gives no file. Other columns are ignored. ``tokenizer`` is the vocabulary file's path on every executor.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(4096))  # parts equal rows; follows from the files' splits alone
    by = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("salt")]
    dealt = rows.select("id", "text", F.xxhash64("text").alias("tie"), salt.alias("salt")).repartitionByRange(parts, *by)
    folder = shared_folder(spark, "tokens")
    files = dealt.sortWithinPartitions(*by).select("id", "text").mapInArrow(_writer(folder, tokenizer, end, file_ids), _MANIFEST)
    files = stored(files, "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            system, name = _open(path)
            with system.open_input_file(name) as f:
                numbers, known, lengths, ids = from_bytes(f.read())
            to = np.cumsum(lengths)
            data = ids.astype("<u4").tobytes()
            i = 0
            while i < len(numbers):
                base = int(to[i] - lengths[i])
                j = max(i + 1, int(np.searchsorted(to, base + RESULT_IDS, "right")))
                cells = [data[4 * int(a) : 4 * int(b)] for a, b in zip(to[i:j] - lengths[i:j], to[i:j])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[i:j], mask=~known[i:j]), pa.array(start + to[i:j] - lengths[i:j]), pa.array(lengths[i:j]),
                     pa.array(cells, pa.binary())], ["id", "start", "n_tokens", "ids"])
                i = j


def read_tokens(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of the files that the table names: ``id_col``, ``start`` (ids of all documents before it), ``n_tokens``
    and ``ids`` (binary, unsigned 32-bit little-endian). Each file is one row, dealt evenly over the tasks."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = files.select("path", "start").repartition(parts, "path")
    return rows.mapInArrow(_read, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
