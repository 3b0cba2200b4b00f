"""Trends, fits and tests. Ranks and cumulative shares come from counts per distinct value."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from faultline.operators.scan import ordered_scan, running_sum
from faultline.session import cut_lineage


def linear_trend(points: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line through the points: slope, intercept, R squared."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return points.groupBy(*keys).agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def range_trends(points: DataFrame, x: str, y: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """A line per given range; a point may count in several ranges."""
    labels = F.filter(
        F.array(*[F.when(F.col(x).between(a, b), F.lit(f"{a}-{b}")) for a, b in ranges]), lambda s: s.isNotNull()
    )
    return linear_trend(points.withColumn("range", F.explode(labels)), x, y, ["range"])


def adaptive_bins(df: DataFrame, year: str, min_rows: int = 20) -> DataFrame:
    """Equal-width year bins, as many as leave at least ``min_rows`` in every bin.

    All bin counts are tried at once on the yearly counts, which are as few as there are years.
    """
    years = df.groupBy(F.col(year).cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    span = years.agg(
        F.struct(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("k"))
    ).scalar()
    tried = years.withColumn("_s", span).filter(F.col("_s.k") > 1).withColumn(
        "bins", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_s.k")))
    )
    lo, width = F.col("_s.lo"), F.col("_s.hi") - F.col("_s.lo")
    # bin i holds the years in (lo + (i-1)w/k, lo + iw/k]; the first year is in bin 1
    i = F.greatest(F.ceil((F.col("y") - lo) * F.col("bins") / width), F.lit(1)).cast("bigint")
    counts = tried.withColumn("bin", i).groupBy("bins", "bin", lo.alias("lo"), width.alias("w")).agg(F.sum("n").alias("n"))
    valid = counts.groupBy("bins").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("filled")).filter(
        (F.col("least") >= min_rows) & (F.col("filled") == F.col("bins"))
    )
    best = valid.agg(F.max("bins")).scalar()
    edge = lambda k: F.floor(F.col("lo") + k * F.col("w") / F.col("bins"))
    first = F.when(F.col("bin") == 1, F.col("lo")).otherwise(edge(F.col("bin") - 1) + 1)
    return counts.filter(F.col("bins") == best).select(
        "bin", first.cast("bigint").alias("year_from"), edge(F.col("bin")).cast("bigint").alias("year_to"), "n"
    )


def year_buckets(df: DataFrame, year: str, values: Sequence[str], buckets: int) -> DataFrame:
    """Consecutive years in buckets: the first holds ``s = floor(span / buckets)`` years, each later
    one ``s + 1``, because the year that closes a bucket opens the next one uncounted."""
    v = [F.sum(c).alias(f"_{c}") for c in values]
    per_year = df.groupBy(F.col(year).alias("_y")).agg(F.count(F.lit(1)).alias("_n"), *v)
    ranked = ordered_scan(per_year, [], ["_y"], {"_r": running_sum(F.lit(1))})
    size = per_year.agg(F.floor((F.max("_y") - F.min("_y")) / buckets)).scalar()
    r = F.col("_r") - 1
    bucket = F.when(r < size, 0).otherwise(F.floor((r - size) / (size + 1)) + 1)
    return ranked.groupBy(bucket.cast("int").alias("bucket")).agg(
        F.min("_y").alias("year_from"),
        F.max("_y").alias("year_to"),
        F.sum("_n").alias("n"),
        *[(F.sum(f"_{c}") / F.sum("_n")).alias(c) for c in values],
    )


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, n, rank): mean rank of each distinct value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = ordered_scan(counts, keys, [value], {"_upto": running_sum("n")})
    return run.select(*keys, value, "n", (F.col("_upto") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation; equal pairs are counted once and weighted."""
    whole = cut_lineage(df.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    rows = whole.groupBy(x, y).agg(F.count(F.lit(1)).alias("_w"))
    rx = average_ranks(whole, x).select(x, F.col("rank").alias("_a"))
    ry = average_ranks(whole, y).select(y, F.col("rank").alias("_b"))
    w, a, b = F.col("_w"), F.col("_a"), F.col("_b")
    s = rows.join(rx, x).join(ry, y).agg(
        F.sum(w).alias("n"),
        F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    )
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    return s.select("n", F.try_divide(cov, F.sqrt(va * vb)).alias("rho"))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Probability of a chi-square value above ``x``; for the one row a test ends in."""

    def tail(v: float, k: int) -> float:
        if v <= 0:
            return 1.0
        # Q(k/2, h) = Q(start) + sum of exp(-h) h^a / gamma(a + 1); each term from logarithms, so none overflows
        h = v / 2
        first = 0.0 if k % 2 == 0 else 0.5
        rest = 0.0 if k % 2 == 0 else math.erfc(math.sqrt(h))
        steps = int(k / 2 - first)
        terms = (math.exp((first + i) * math.log(h) - h - math.lgamma(first + i + 1)) for i in range(steps))
        return min(1.0, rest + math.fsum(terms))

    return pd.Series([tail(float(a), int(b)) for a, b in zip(x, df)])


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, its degrees of freedom and p-value."""
    df = cut_lineage(df.select(group, value))
    ranks = cut_lineage(average_ranks(df, value))
    cells = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    sums = (
        cells.join(ranks.select(value, "rank"), value)
        .groupBy(group)
        .agg(F.sum(F.col("_c") * F.col("rank")).alias("r"), F.sum("_c").alias("m"))
    )
    t = F.col("n").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t)).scalar()
    n = F.sum("m").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("m")) - 3 * (n + 1)
    return sums.agg(
        h.alias("_h"), n.alias("_n"), (F.count(F.lit(1)) - 1).alias("df")
    ).select((F.col("_h") / (1 - ties / (F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")))).alias("h"), "df").withColumn(
        "p_value", chi_square_tail("h", "df")
    )


def exponential_fit(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Shifted exponential (location = minimum, scale = mean - minimum) and the Kolmogorov-Smirnov
    distance of the data to it, per key."""
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = ordered_scan(counts, keys, ["_v"], {"_upto": running_sum("_n")})
    fit = run.groupBy(*keys).agg(
        F.min("_v").alias("loc"),
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n") - F.min("_v")).alias("scale"),
        F.sum("_n").alias("n"),
    )
    if keys:
        both = run.join(fit, keys)
    else:
        s = fit.select(F.struct("loc", "scale", "n")).scalar()
        both = run.withColumn("_f", s).select("*", "_f.*").drop("_f")
    cdf = 1 - F.exp(-(F.col("_v") - F.col("loc")) / F.col("scale"))
    above = F.col("_upto") / F.col("n") - cdf
    below = cdf - (F.col("_upto") - F.col("_n")) / F.col("n")
    return both.groupBy(*keys, "loc", "scale", "n").agg(F.max(F.greatest(above, below)).alias("ks"))


def period_of(year: str, cut_offs: Sequence[int]):
    """The first cut-off year not before ``year``; null after the last one."""
    return F.coalesce(*[F.when(F.col(year) <= c, F.lit(c)) for c in sorted(cut_offs)])


def constant_factor(df: DataFrame, split: int) -> DataFrame:
    """Learn the mean gap between bound and truth before ``split``; compare errors from then on.

    ``df`` has fix_date, true_date, oldest_date, est_date.
    """
    gap = F.date_diff("true_date", "oldest_date")
    bound_life = F.date_diff("fix_date", "oldest_date")
    early = F.year("fix_date") < split
    known = df.filter(F.col("true_date").isNotNull())
    learned = known.filter(early).agg(
        F.struct(
            F.avg(gap).alias("c"),
            (F.sum(F.when(bound_life != 0, gap / bound_life)) / F.count(F.lit(1))).alias("p"),
        )
    ).scalar()
    life = F.date_diff("fix_date", "true_date")
    late = known.filter(~early).withColumn("_l", learned)
    return late.agg(
        F.first("_l.c").alias("constant_days"),
        F.first("_l.p").alias("constant_share"),
        F.avg(F.date_diff("true_date", "est_date")).alias("error_weighted"),
        F.avg(gap - F.col("_l.c")).alias("error_constant"),
        F.avg(life - (bound_life + F.col("_l.p") * bound_life)).alias("error_share"),
        F.count(F.lit(1)).alias("n"),
    )


def bound_errors(df: DataFrame, min_rows: int = 20) -> DataFrame:
    """Per year of the fix: mean distance of estimate and lower bound to the truth, in percent of the
    mean true lifetime."""
    known = df.filter(F.col("true_date").isNotNull())
    life = F.avg(F.date_diff("fix_date", "true_date"))
    return (
        known.groupBy(F.year("fix_date").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.avg(F.date_diff("true_date", "est_date")) / life * 100).alias("pct_estimate"),
            (F.avg(F.date_diff("true_date", "newest_date")) / life * 100).alias("pct_lower"),
        )
        .filter(F.col("n") >= min_rows)
    )


def mean_interval(df: DataFrame, keys: Sequence[str], value: str, n: int | None = None, z: float = 1.96) -> DataFrame:
    """Normal interval around the mean, for the rows there are or for a sample of ``n``."""
    size = F.lit(float(n)) if n else F.count(value)
    half = z * F.stddev_samp(value) / F.sqrt(size)
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high")
    )


def drawn_counts(rng: np.random.Generator, sizes: np.ndarray, take: int, rounds: int) -> np.ndarray:
    """How many of each value fall to a group of ``take`` rows, ``rounds`` times: multivariate hypergeometric draws.

    Beyond 10^9 rows numpy does not draw them; there the values are drawn one after the other, each from the normal
    limit of its own hypergeometric count (whose deviation is above 1e4 rows where it matters), rounded and kept within
    what is possible."""
    total = int(sizes.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(sizes, take, size=rounds, method="marginals")
    out = np.zeros((rounds, len(sizes)), np.int64)
    left, open_ = np.full(rounds, take, np.int64), total
    for i, size in enumerate(sizes.tolist()):
        share = left / open_
        spread = np.sqrt(np.maximum(size * share * (1 - share) * (open_ - size) / max(1, open_ - 1), 0))
        drawn = np.rint(rng.normal(size * share, spread)).astype(np.int64)
        out[:, i] = np.clip(drawn, np.maximum(0, left - (open_ - size)), np.minimum(size, left))
        left, open_ = left - out[:, i], max(1, open_ - size)
    return out


def subset_sums(rng: np.random.Generator, values: np.ndarray, take: int, rounds: int, cells: int = 1 << 22) -> np.ndarray:
    """Sums of ``rounds`` subsets of ``take`` of the whole numbers ``values``, each subset equally likely.

    Every row is taken by one random byte against a limit, so a round's first set is equally likely among those of
    its size, whatever the limit. Then rows at random are left out or added until it has ``take``, about the
    square root of their number. The sums are matrix products over bytes of the values, exact in single precision."""
    n = len(values)
    if take in (0, n):
        return np.full(rounds, int(values.sum()) if take else 0, np.int64)
    low = int(values.min())
    above = (values - low).astype(np.uint64)
    limbs = max(1, -(-int(above.max()).bit_length() // 8))
    parts = np.stack([(above >> np.uint64(8 * i) & np.uint64(255)).astype(np.float32) for i in range(limbs)], 1)
    scale = np.array([1 << 8 * i for i in range(limbs)], np.float64)
    limit = min(255, max(1, round(256 * take / n)))
    out, step = np.empty(rounds, np.int64), max(1, cells // n)
    for first in range(0, rounds, step):
        m = min(step, rounds - first)
        chosen = np.frombuffer(rng.bytes(m * n), np.uint8).reshape(m, n) < limit  # a copy that can be changed
        over = chosen.view(np.uint8).sum(1, dtype=np.int32) - take
        flat, base, left, surplus = chosen.reshape(-1), np.arange(m) * n, np.abs(over), over > 0
        while True:
            live = left > 0
            base, left, surplus = base[live], left[live], surplus[live]
            if not len(base):
                break
            at = base + rng.integers(0, n, len(base), dtype=np.int32)
            was = flat[at]
            hit = was == surplus
            flat[at] = was ^ hit
            left = left - hit
        total = np.zeros((m, limbs))
        for i in range(0, n, 1 << 15):  # 255 * 2**15 stays below 2**24
            total += chosen[:, i : i + (1 << 15)].astype(np.float32) @ parts[i : i + (1 << 15)]
        out[first : first + m] = np.rint(total @ scale).astype(np.int64) + low * take
    return out


#: How many rows of `subset_sums` cost as much as one value of `drawn_counts`.
ROWS_PER_VALUE = 40


def permuted_sums(rng: np.random.Generator, values: np.ndarray, counts: np.ndarray, take: int, rounds: int) -> np.ndarray:
    """Sums of a random group of ``take`` rows out of rows with these distinct values, by whichever way costs less: row by
    row, or by drawing how many rows of each value the group gets. Both draw from the same distribution. Sums are of the
    smaller group, and the other's follow."""
    size = int(counts.sum())
    if size <= ROWS_PER_VALUE * len(values):
        rows = np.repeat(values, counts)
        if 2 * take > size:
            return int(rows.sum()) - subset_sums(rng, rows, size - take, rounds)
        return subset_sums(rng, rows, take, rounds)
    out, step = np.empty(rounds, np.int64), max(1, (1 << 22) // len(values))
    for first in range(0, rounds, step):
        m = min(step, rounds - first)
        out[first : first + m] = drawn_counts(rng, counts, take, m) @ values
    return out


def _more_counts(rng: np.random.Generator, rest: np.ndarray, take: np.ndarray) -> np.ndarray:
    """`drawn_counts` with a row of sizes and a group size per round."""
    out = np.zeros(rest.shape, np.int64)
    left, open_ = take.copy(), rest.sum(1)
    for i in range(rest.shape[1]):
        size = rest[:, i]
        if int(open_.max()) < 10**9:
            out[:, i] = rng.hypergeometric(size, open_ - size, left)
        else:
            share = left / np.maximum(1, open_)
            spread = np.sqrt(np.maximum(size * share * (1 - share) * (open_ - size) / np.maximum(1, open_ - 1), 0))
            drawn = np.rint(rng.normal(size * share, spread)).astype(np.int64)
            out[:, i] = np.clip(drawn, np.maximum(0, left - (open_ - size)), np.minimum(size, left))
        left, open_ = left - out[:, i], open_ - size
    return out


def prefix_sums(
    rng: np.random.Generator, values: np.ndarray, counts: np.ndarray, places: np.ndarray, cells: int = 1 << 22
) -> np.ndarray:
    """Sums of the first ``places`` rows, (rounds, any number of places), of rows with these values and counts that every
    round puts in a new random order; by whichever way costs less, as in `permuted_sums`.

    Few rows per value: every row draws a number, and only rows whose numbers lie about the places are sorted by them.
    Many: the counts up to the smallest place of all are drawn at once. Then a round takes row after row at random from
    those that it has not yet, and notes its sum at each of its places; a long way between two places is drawn at once too."""
    size = int(counts.sum())
    out = np.zeros(places.shape, np.int64)
    if size <= ROWS_PER_VALUE * len(values):
        rows, slack = np.repeat(values, counts), 2.5 * np.sqrt(size) + 1
        for i, asked in enumerate(places):
            low, high = int(asked.min()), int(asked.max())
            number = rng.random(size)
            below, upto = number < (low - slack) / size, number < (high + slack) / size
            before, band = np.count_nonzero(below), np.flatnonzero(upto ^ below)
            if before > low or before + len(band) < high:  # the places lie outside: sort all
                before, band = 0, np.arange(size)
            start = int(rows[below].sum()) if before else 0
            band = rows[band[np.argsort(number[band])]]
            out[i] = start + np.concatenate(([0], np.cumsum(band)))[asked - before]
        return out
    starts = np.cumsum(counts) - counts
    step = max(1, cells // len(values))
    for first in range(0, len(places), step):
        asked = places[first : first + step]
        rounds, at = np.arange(len(asked)), int(asked.min())
        taken = drawn_counts(rng, counts, at, len(asked)) if at else np.zeros((len(asked), len(values)), np.int64)
        total, reached = taken @ values, np.full(len(asked), at, np.int64)
        for column in np.argsort(asked, axis=1).T:
            goal = asked[rounds, column]
            live, left = rounds, goal - reached
            if int(left.max()) > len(values):
                more = _more_counts(rng, counts - taken, left)
                taken, total, left = taken + more, total + more @ values, np.zeros_like(left)
            while len(live := live[keep := left > 0]):
                left = left[keep]
                row = rng.integers(0, size, len(live))
                value = np.searchsorted(starts, row, "right") - 1
                hit = row - starts[value] >= taken[live, value]  # else the round has this row
                taken[live, value] += hit
                total[live] += values[value] * hit
                left = left - hit
            reached = goal
            out[first + rounds, column] = total
    return out


def pairwise_permutation(
    df: DataFrame, group: str, value: str, rounds: int = 100_000, seed: int = 0, rounds_per_task: int = 20_000
) -> DataFrame:
    """Two-sided permutation test of the difference in means for every pair of groups: ``difference`` and ``p_value``
    (rounds at least as extreme, the data themselves counted as one of them).

    Permuting labels only moves counts between equal values, so the data are first counted per (group, whole number).
    A random group of the first one's size out of both has a hypergeometric number of rows from either, and these are a
    random part of each. So every round puts each group's rows in one random order, and a pair reads off its sums at its
    own numbers of rows: a group is shuffled once per round, not once per round and partner. Each pair has all its
    rounds, each with a permutation equally likely among all; only tests that share a group share its orders. Rounds are
    spread over tasks by group, each with its own seeded stream. Groups are categories: as many rows as pairs of them,
    and each holds one entry per distinct value.
    """
    counts = df.groupBy(F.col(group).alias("g"), F.col(value).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.filter("v IS NOT NULL AND g IS NOT NULL"))
    whole = counts.groupBy("g").agg(
        F.sum("n").alias("size"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.sum(F.col("v") * F.col("n")).alias("total"),
        F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"),
    )
    whole = cut_lineage(whole)
    # names and sizes are as few as categories
    names = whole.agg(F.sort_array(F.collect_list(F.struct("g", "size", "mean", "total")))).scalar()
    chunks = -(-rounds // rounds_per_task)
    work = whole.select(
        "g", "size", F.col("p.v").alias("values"), F.col("p.n").alias("counts"), names.alias("names"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
    ).select("*", F.col("names.g").alias("partners"), F.col("names.size").alias("sizes")).drop("names")
    work = work.repartition(max(1, chunks) * 32, "g", "chunk")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                todo = min(rounds_per_task, rounds - row.chunk * rounds_per_task)
                size = int(row.size)
                values, counts = np.asarray(row.values, np.int64), np.asarray(row.counts, np.int64)
                partners = [(g, int(n)) for g, n in zip(row.partners, row.sizes) if g != row.g]
                if not partners:
                    continue
                places = np.empty((todo, len(partners)), np.int64)
                for i, (g, n) in enumerate(partners):
                    pair = [(row.g, size), (g, n)] if row.g < g else [(g, n), (row.g, size)]
                    both = np.random.default_rng([seed, 0, row.chunk, *f"{pair[0][0]}|{pair[1][0]}".encode()])
                    drawn = drawn_counts(both, np.array([pair[0][1], pair[1][1]], np.int64), pair[0][1], todo)
                    places[:, i] = drawn[:, 0 if row.g < g else 1]
                rng = np.random.default_rng([seed, 1, row.chunk, *f"{row.g}".encode()])
                # parts above the half are what the others leave
                back = places.mean(0) > 0.6 * size
                sums = np.empty_like(places)
                if (~back).any():
                    sums[:, ~back] = prefix_sums(rng, values, counts, places[:, ~back])
                if back.any():
                    sums[:, back] = int(values @ counts) - prefix_sums(rng, values, counts, size - places[:, back])
                for i, (g, _) in enumerate(partners):
                    a, b = sorted((row.g, g))
                    yield pd.DataFrame({"a": [a], "b": [b], "chunk": [row.chunk], "sums": [sums[:, i]]})

    kind = dict(df.dtypes)[group]
    parts = work.mapInPandas(draw, f"a {kind}, b {kind}, chunk int, sums array<bigint>")
    # the two parts of a pair's random group, added up round by round
    either = parts.groupBy("a", "b", "chunk").agg(F.collect_list("sums").alias("s"))
    first = F.zip_with(F.get("s", F.lit(0)), F.get("s", F.lit(1)), lambda x, y: x + y)
    of = lambda name, p: whole.select(F.col("g").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in ("size", "mean", "total")])
    pairs = either.select("a", "b", first.alias("first")).join(F.broadcast(of("a", "a")), "a").join(F.broadcast(of("b", "b")), "b")
    everything = F.col("a_total") + F.col("b_total")
    observed = F.abs(F.col("a_mean") - F.col("b_mean"))
    gap = lambda s: F.abs(s / F.col("a_size") - (everything - s) / F.col("b_size"))
    extreme = F.size(F.filter("first", lambda s: gap(s) >= observed - 1e-9))
    done = pairs.select("a", "b", (F.col("a_mean") - F.col("b_mean")).alias("difference"), extreme.alias("extreme"), F.size("first").alias("rounds"))
    return done.groupBy("a", "b").agg(
        F.first("difference").alias("difference"),
        ((F.sum("extreme") + 1) / (F.sum("rounds") + 1)).alias("p_value"),
        F.sum("rounds").alias("rounds"),
    )
