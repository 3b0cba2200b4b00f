"""Decayed sums against the plain sum over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import decay, history as h

DAY = 86_400


@pytest.mark.parametrize("span,n", [(0.001, 300), (3.0, 400), (40.0, 500), (9000.0, 900)])
def test_tree_equals_plain_sum(span, n):
    rng = np.random.default_rng(int(span * 10) + n)
    times = np.sort(np.concatenate([10_000 + rng.random(n) * span, 10_000 + np.repeat(rng.random(3) * span, 5)]))
    leaf = np.floor(times * decay.QUARTERS).astype(np.int64)
    names, first = np.unique(leaf, return_index=True)
    delta = times - (leaf + 0.5) / decay.QUARTERS
    moments = np.add.reduceat(delta[:, None] ** np.arange(decay.TERMS), first)
    got = decay.weigh_earlier(np.zeros(len(names), int), names, moments, np.zeros(len(times), int), times)
    want = [(1 / (t - times[leaf < b] + 1)).sum() for t, b in zip(times, leaf)]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def plain(rows):
    """commit -> sum, rows of one author in (seconds, commit) order, touches of a commit together."""
    t = np.array([r[0] for r in rows]) / DAY
    n = np.array([r[2] for r in rows], float)
    return {r[1]: float((n[: i + 1] / (t[i] - t[: i + 1] + 1)).sum()) for i, r in enumerate(rows)}


def test_recent_experience_with_times_of_day(spark):
    """A hundred thousand touches of one author, and a few small authors, one of them null."""
    rng = np.random.default_rng(5)
    hot = 20_000
    seconds = np.sort(rng.integers(0, 4000 * DAY, hot))
    seconds[500:3500] = seconds[500] + np.sort(rng.integers(0, DAY, 3000))  # a busy day
    seconds.sort()
    rows = [("bot", int(s), i, 5) for i, s in enumerate(seconds)]
    for a in ("x", "y", None):
        rows += [(a, int(s), hot + len(rows) + i, int(k)) for i, (s, k) in enumerate(zip(np.sort(rng.integers(0, 900 * DAY, 40)), rng.integers(1, 9, 40)))]
    df = spark.createDataFrame(rows, "author string, s long, commit_id long, touches long")
    df = df.select("author", "commit_id", F.timestamp_seconds("s").alias("commit_date"), "touches")
    got = {r["commit_id"]: r["rexp"] for r in h.recent_experience(df).collect()}
    assert len(got) == len(rows)
    for a in ("bot", "x", "y", None):
        for commit, want in plain(sorted((s, c, n) for b, s, c, n in rows if b == a)).items():
            assert got[commit] == pytest.approx(want, rel=1e-9)


def test_no_rows(spark):
    df = spark.createDataFrame([], "author string, commit_id long, commit_date timestamp, touches long")
    assert h.recent_experience(df).count() == 0
