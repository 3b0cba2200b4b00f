"""Quality classifier: random-indexing vectors pooled per document, and a two-layer network with calibrated scores.

*Vectors.* Every word, and every word's shape (its runs of capitals, small letters, digits and single signs, so that
``THE!!`` is ``A!``), is hashed to one of ``VOCABULARY`` rows. A row's vector is the sum of the sparse random index
vectors of the words within two places of it, over all documents. The sums are whole numbers, so they do not depend on how
the corpus is cut; each task sends its table once, and tables are added in a stream, salted, then again.

*Network.* Documents become the weighted means of their words' and shapes' vectors and their length. A hidden layer and a
sigmoid, trained with numpy on a bounded sample of labelled rows (``most_labels``, in the order of a seeded hash); a fifth
of the sample sets the temperature. Scoring is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from faultline.llm import text as tx
from faultline.llm.memory import release

VOCABULARY, WIDTH, NONZERO, REACH, BLOCK_ROWS = 1 << 14, 32, 2, 2, 1024
COMMON = 1e-3  # words more frequent than this count less in the mean
SAMPLE = 20_000
# text in one numpy pass, which takes some hundred times as much memory; learning adds up whole tables in each
SCORED_BYTES, LEARNED_BYTES = 1 << 19, 1 << 20

_KIND = np.arange(256)  # every sign is a kind of its own
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 65, 97, 48, 97


def _streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word bucket and shape bucket of every word."""
    t = tx.tokens(texts)
    if not len(t.row):
        return t.row, np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = t.end - t.start
    first = np.cumsum(size) - size
    index = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(t.start, size)
    kind = _KIND[t.data[index]]
    new = np.append(True, kind[1:] != kind[:-1])
    new[first] = True
    place = np.cumsum(new)
    place -= np.repeat(place[first], size)
    value = tx.seeded(3, (kind * 64 + np.minimum(place, 63)).astype(np.uint64)) * new.astype(np.uint64)
    shape = tx.mixed(np.add.reduceat(value, first))
    half = np.uint64(VOCABULARY // 2)
    return t.row, (t.hash % half).astype(np.int64), (shape % half + half).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    rng = np.random.default_rng(23)
    return rng.integers(0, WIDTH, (VOCABULARY, NONZERO)), rng.choice([-1, 1], (VOCABULARY, NONZERO))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    table = np.zeros((VOCABULARY, WIDTH + 1), np.int64)  # the last column counts the row's words
    for batch in batches:
        for part in tx.chunks(batch, "text", LEARNED_BYTES):
            row, word, shape = _streams(part.column("text"))
            for ids in (word, shape):
                table[:, WIDTH] += np.bincount(ids, minlength=VOCABULARY)
                sums = np.zeros(VOCABULARY * WIDTH)
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(row[step:] == row[:-step])
                    x, y = ids[near], ids[near + step]
                    for a, b in ((x, y), (y, x)):
                        for k in range(NONZERO):
                            sums += np.bincount(a * WIDTH + places[b, k], signs[b, k], minlength=len(sums))
                table[:, :WIDTH] += np.rint(sums).astype(np.int64).reshape(VOCABULARY, WIDTH)
    salt = int(table.sum() % 16)
    for block in range(VOCABULARY // BLOCK_ROWS):
        own = table[block * BLOCK_ROWS : (block + 1) * BLOCK_ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["block", "salt", "sums"]
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the tables of each block, one row at a time."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums")):
            own = np.frombuffer(sums.as_buffer(), np.int64)
            total[block] = total[block] + own if block in total else own.copy()
    for block, own in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["block", "salt", "sums"]
        )


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Weighted vectors of all rows of the vocabulary, learned from the column ``text`` of all rows."""
    schema = "block int, salt int, sums binary"
    parts = texts.mapInArrow(_contexts, schema).repartition("block", "salt").mapInArrow(_added, schema)
    rows = parts.repartition("block").mapInArrow(_added, schema).collect()  # the table's fixed size
    table = np.zeros((VOCABULARY, WIDTH + 1), np.int64)
    for r in rows:
        own = np.frombuffer(r["sums"], np.int64).reshape(BLOCK_ROWS, WIDTH + 1)
        table[r["block"] * BLOCK_ROWS : (r["block"] + 1) * BLOCK_ROWS] += own
    vectors, n = table[:, :WIDTH].astype(float), table[:, WIDTH].astype(float)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = n / max(1.0, n.sum() / 2)
    return (vectors * (COMMON / (COMMON + share))[:, None]).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of a chunk of texts: mean vectors of words and shapes, and log of the number of words."""
    row, word, shape = _streams(texts)
    n = len(texts)
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    out = np.zeros((n, 2 * WIDTH + 1))
    some = np.flatnonzero(count)
    if len(some):
        for k, ids in enumerate((word, shape)):
            sums = np.add.reduceat(vectors[ids], first[some], axis=0, dtype=np.float64)
            out[some, k * WIDTH : (k + 1) * WIDTH] = sums / count[some, None]
    out[:, -1] = np.log1p(count)
    return out


@dataclass
class Network:
    """Standardisation, two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5, decay: float = 1e-3) -> Network:
    """Adam on the log loss; every fifth row is kept out and sets the temperature. One class or no rows: the share of 1."""
    width = x.shape[1] if x.ndim == 2 else 2 * WIDTH + 1
    rng = np.random.default_rng(seed)
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0)
    if len(y) < 10 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        flat.b2 = float(np.log(p / (1 - p)))
        return flat
    held = np.arange(len(y)) % 5 == 4
    if y[~held].min() == y[~held].max():
        held[:] = False
    net = Network(x[~held].mean(0), x[~held].std(0) + 1e-6, rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden),
                  rng.normal(0, hidden**-0.5, hidden), 0.0)
    z, t = (x[~held] - net.mean) / net.scale, y[~held]
    params = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 256):
            i = order[at : at + 256]
            h = np.tanh(z[i] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            d = (p - t[i]) / len(i)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[i].T @ back + decay * params[0], back.sum(0), h.T @ d + decay * params[2], d.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
    if held.any():
        logits, t = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        net.temperature = float(grid[np.argmin([_loss(logits / g, t) for g in grid])])
    return net


def held_out(id_: Column, folds: int = 5, fold: int = 0) -> Column:
    """Rows whose crc32 of the id as text falls into ``fold``; a null id is hashed as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(folds)) == fold


def _features(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text", SCORED_BYTES):
                x = pooled(part.column("text"), vectors)
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    return run


def _scored(vectors: np.ndarray, net: Network, place: int | None = None):
    """``place``: of the text among the fields of ``rec``; else it is a column of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec = batch.column("rec")
            both = batch if place is None else pa.RecordBatch.from_arrays([rec, rec.field(place)], ["rec", "text"])
            for part in tx.chunks(both, "text", SCORED_BYTES):
                score = net.scores(pooled(part.column("text"), vectors))
                yield pa.RecordBatch.from_arrays([part.column("rec"), pa.array(score)], ["rec", "score"])
            del batch, rec, both, part
            release()  # a worker of a later stage of the pipeline goes without it

    return run


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns of ``docs`` as the struct ``rec``, and ``score``. A text that is a column of strings already travels
        once, within the struct."""
        shaped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"))
        schema = StructType([shaped.schema["rec"], StructField("score", DoubleType())])
        places = [i for i, f in enumerate(docs.schema) if f.name == text_col and f.dataType == StringType()]
        place = places[0] if len(places) == 1 else None
        if place is None:
            shaped = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"))
        return shaped.mapInArrow(_scored(self.vectors, self.network, place), schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        most_labels: int = SAMPLE, seed: int = 5) -> QualityModel:
    """Vectors from all of ``docs``; network from at most ``most_labels`` rows of ``labels`` outside the held-out fold.
    Labels other than 0 and 1, and rows with a null id, are left out. Repeated label rows count each."""
    vectors = word_vectors(docs.select(F.col(text_col).cast("string").alias("text")))
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("l_id").isNotNull() & F.col("y").isin(0, 1)
    )
    sample = known.filter(~held_out(F.col("l_id"))).orderBy(F.xxhash64(F.lit(seed), "l_id"), "l_id", "y").limit(most_labels)
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(sample), F.col("d_id") == F.col("l_id")  # most_labels rows
    )
    found = rows.select("y", "text").mapInArrow(_features(vectors), "y int, x binary").limit(2 * most_labels).toArrow()
    cells = found["x"].to_pylist()
    order = sorted(range(len(cells)), key=lambda i: cells[i])  # not in the order of arrival
    x = np.frombuffer(b"".join(cells[i] for i in order), np.float64).reshape(len(cells), -1) if cells else np.zeros((0, 2 * WIDTH + 1))
    mix = np.random.default_rng(seed).permutation(len(cells))
    return QualityModel(vectors, train(x[mix], found["y"].to_numpy()[order][mix].astype(float), seed=seed))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.3,
                   **options) -> DataFrame:
    """One row per input row: ``id_col``, ``held_out``, ``score`` (0 to 1, higher: label 1 is likelier), ``predicted``
    (1 from ``limit`` on).

    Defined cases: null and empty texts are scored as texts without words. Rows with a null id are scored and never
    learned from. Without usable labels every score is the same. Very long texts are scored whole. An empty table gives
    an empty result; extra columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col, **options)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shaped = narrow.select("text", F.struct("id").alias("rec"))
    schema = StructType([shaped.schema["rec"], StructField("score", DoubleType())])
    out = shaped.mapInArrow(_scored(model.vectors, model.network), schema)
    return out.select(
        F.col("rec.id").alias(id_col), held_out(F.col("rec.id")).alias("held_out"), "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )
