"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors are one class with a count from the start. Every class enters ``tables`` hash tables; a table's key is the
signs of the products with ``bits`` random hyperplanes. Classes that share a key are compared by exact cosine in blocks
of bounded size, and a pair counts in the first table that brings it together, so it is counted once. Blocks give sums
and one edge per class, never lists of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm.components import connected_components
from faultline.llm.storage import stored

BLOCK = 512


def tables_for(rows: int, cosine: float, miss: float) -> tuple[int, int]:
    """Bits per key and number of tables: keys long enough that unrelated rows seldom share one, and as many
    tables as bring a pair at exactly ``cosine`` together with probability 1 - ``miss``. The same rule at every size."""
    bits = max(8, math.ceil(math.log2(max(2, rows))) + 1)
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def hyperplanes(seed: int, count: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((count, width))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, valid = batch.column("vector"), []
        for cell in column:
            own = cell.values.to_numpy(zero_copy_only=False).astype(np.float64) if cell.is_valid else np.zeros(0)
            good = len(own) and np.isfinite(own).all() and np.any(own)
            if good:
                own = own / np.abs(own).max() + 0.0  # keeps norms of huge and tiny vectors in range; -0 becomes 0
            valid.append(own.tobytes() if good else None)
        known = np.asarray(batch.column("id").is_valid())
        vectors = pa.array([v if k else None for v, k in zip(valid, known)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), vectors], ["id", "vector"])


def _matrix(cells: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _keys_of(seed: int, bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (1 << np.arange(bits, dtype=np.int64)) if bits < 63 else None
        for batch in batches:
            ids, n = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            cells = batch.column("vector").to_pylist()
            widths = np.array([len(c) // 8 for c in cells])
            for width in np.unique(widths):
                mine = np.flatnonzero(widths == width)
                for part in np.array_split(mine, max(1, len(mine) // 2000)):
                    own = [cells[i] for i in part]
                    signs = _matrix(own) @ hyperplanes(seed, bits * tables, int(width)).T >= 0
                    codes = signs.reshape(len(part), tables, bits) @ weight
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[part]), pa.array(n[part]), pa.array(np.full(len(part), width, np.int32)),
                         pa.array(own, pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                        ["rep", "n", "width", "vector", "codes"],
                    )

    return run


def _least_labels(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component under a symmetric boolean matrix."""
    label = ids.copy()
    while True:
        spread = np.where(linked, label[None, :], label[:, None]).min(1)
        spread = np.minimum(spread, label)
        if (spread == label).all():
            return label
        label = spread


_FOUND = ("rep", "links", "label")
SMALL = 48  # blocks up to this size are compared together, by lists of index pairs


def _pairs_of_small(start: np.ndarray, size: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j inside each run; in a run of two blocks only pairs across the sides."""
    i, j = [], []
    for n in np.unique(size):
        a, b = np.triu_indices(n, 1)
        of = start[size == n][:, None]
        i.append((of + a).ravel())
        j.append((of + b).ravel())
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
    two = np.zeros(len(side), bool)  # rows of runs that hold both sides
    for s, n in zip(start, size):
        two[s : s + n] = side[s] != side[s + n - 1]
    keep = ~two[i] | (side[i] != side[j])
    return i[keep], j[keep]


def _compared(cosine: float):
    """Blocks of many buckets at once: links per vector counted in their first table, and one label per vector."""

    def run(table: pa.Table) -> pa.Table:
        keys = ["t", "width", "code", "low", "high"]
        table = table.sort_by([(c, "ascending") for c in [*keys, "side", "rep"]])
        cols = {c: table[c].to_numpy() for c in [*keys, "side", "rep", "n"]}
        ids, n, side, t = cols["rep"], cols["n"], cols["side"], cols["t"]
        new = np.zeros(len(ids), bool)
        new[:1] = True
        for c in keys:
            new[1:] |= cols[c][1:] != cols[c][:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(ids)))
        cells, codes = table["vector"].to_pylist(), table["codes"].combine_chunks()
        total, label = np.zeros(len(ids), np.int64), ids.copy()
        flat, at = codes.flatten().to_numpy(), np.append(0, np.cumsum(codes.value_lengths().to_numpy()))

        def counted(i: np.ndarray, j: np.ndarray, first: int, last: int) -> None:
            own = flat[at[first] : at[last]].reshape(last - first, -1)
            earlier = np.arange(own.shape[1]) < t[i][:, None] if len(i) else np.zeros((0, own.shape[1]), bool)
            fresh = ~((own[i - first] == own[j - first]) & earlier).any(1)
            np.add.at(total, i[fresh], n[j[fresh]])
            np.add.at(total, j[fresh], n[i[fresh]])

        for width in np.unique(cols["width"]):  # sorted by t first: look at runs of one width at a time
            few = np.flatnonzero((size <= SMALL) & (cols["width"][start] == width))
            for part in np.array_split(few, max(1, len(few) // 2000)):
                if not len(part):
                    continue
                rows = np.concatenate([np.arange(s, s + k) for s, k in zip(start[part], size[part])])
                x = _matrix([cells[r] for r in rows])
                begin = np.cumsum(size[part]) - size[part]
                i, j = _pairs_of_small(begin, size[part], side[rows])
                close = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                i, j = i[close], j[close]
                own = np.stack([flat[at[r] : at[r + 1]] for r in rows])
                earlier = np.arange(own.shape[1])[None, :] < t[rows[i]][:, None]
                fresh = ~((own[i] == own[j]) & earlier).any(1)
                np.add.at(total, rows[i[fresh]], n[rows[j[fresh]]])
                np.add.at(total, rows[j[fresh]], n[rows[i[fresh]]])
                own_label = ids[rows].copy()
                while len(i):
                    before = own_label.copy()
                    low = np.minimum(own_label[i], own_label[j])
                    np.minimum.at(own_label, i, low)
                    np.minimum.at(own_label, j, low)
                    if (before == own_label).all():
                        break
                label[rows] = own_label
        for s, k in zip(start[size > SMALL], size[size > SMALL]):
            x = _matrix(cells[s : s + k])
            half = int(np.searchsorted(side[s : s + k], 1))
            one = half in (0, k)  # a block against itself
            left, right = np.arange(k if one else half), np.arange(0 if one else half, k)
            close = x[left] @ x[right].T >= cosine
            if one:
                np.fill_diagonal(close, False)
            whole = np.zeros((k, k), bool)
            whole[np.ix_(left, right)] = close
            whole |= whole.T
            i, j = np.nonzero(np.triu(whole, 1))
            counted(s + i, s + j, s, s + k)
            label[s : s + k] = _least_labels(whole, ids[s : s + k])
        keep = (total > 0) | (label != ids)
        return pa.table([pa.array(ids[keep]), pa.array(total[keep]), pa.array(label[keep])], _FOUND)

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, seed: int = 11,
    miss: float = 0.001, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_links`` (other vectors at ``cosine`` or more that were found),
    ``component_id`` (smallest id reachable by links), ``kept`` (the id is its component's).

    No pair below ``cosine`` is linked; a pair at exactly ``cosine`` is found with probability 1 - ``miss``, closer pairs
    more surely, equal vectors always.

    Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
    their own component; so do rows with a null id (null component, kept). Vectors of different length never link. Rows
    that repeat an id are vectors of their own. An empty table gives an empty result; other columns are ignored.
    """
    parsed = stored(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).mapInArrow(
            _parsed, "id long, vector binary"
        ),
        "vectors",
    )
    classes = stored(
        parsed.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("class", F.xxhash64("vector")),
        "classes",
    )
    bits, tables = tables_for(classes.count(), cosine, miss)
    # the smallest id of a class names it; rows that share an id but not a vector need names of their own
    named = classes.select(F.col("class").alias("rep"), "n", "vector")
    signed = stored(
        named.mapInArrow(
            _keys_of(seed, bits, tables), "rep long, n long, width int, vector binary, codes array<long>"
        ),
        "signed",
    )
    bucket = ["t", "width", "code"]
    keyed = signed.select("rep", "width", F.posexplode("codes").alias("t", "code"))
    sizes = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / block).cast("int")
    cut = keyed.join(sizes, bucket).withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("rep", "t"), F.col("parts")).cast("int"))
    # a bucket of several blocks: every block meets every other and itself; vectors join only what shares a bucket
    met = cut.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "t", "code", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), (F.col("p") > F.col("q")).cast("int").alias("side"), "rep",
    ).join(signed, "rep")
    # blocks of many buckets in one call; the rows of a call are bounded by what a few blocks hold
    calls = max(1, math.ceil(keyed.count() / 20_000))
    call = F.pmod(F.xxhash64(*bucket, "low", "high"), F.lit(calls)).cast("int")
    found = stored(
        met.withColumn("call", call).groupBy("call").applyInArrow(_compared(cosine), "rep long, links long, label long"), "found"
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("rep", "label").distinct(), "rep", "label")
    judged = (
        classes.join(links, classes["class"] == links["rep"], "left").drop(links["rep"])
        .join(parts, classes["class"] == parts["node"], "left")
        .select("vector", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "class").alias("part"))
    )
    least = judged.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = judged.join(least, "part").select("vector", "n_links", "component_id")
    return parsed.join(named, "vector", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
