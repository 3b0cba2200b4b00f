"""Curves and areas on small hand-made scores, and their invariants."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import metrics as m

# y_true, y_pred; two tied scores
SCORES = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.7), (0, 0.3), (1, 0.2), (0, 0.1)]


def brute_auc(scores):
    pos = [p for t, p in scores if t == 1]
    neg = [p for t, p in scores if t == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def pred(spark):
    return spark.createDataFrame([("m", i, t, p) for i, (t, p) in enumerate(SCORES)], "model string, id int, y_true int, y_pred double")


def test_roc_auc_is_the_pair_share(pred):
    got = m.roc_area(m.threshold_curve(pred)).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(SCORES))


def test_auc_unchanged_by_monotone_transform(pred):
    a = m.roc_area(m.threshold_curve(pred)).first()["roc_auc"]
    b = m.roc_area(m.threshold_curve(pred.withColumn("y_pred", F.exp(3 * F.col("y_pred"))))).first()["roc_auc"]
    assert a == pytest.approx(b)


def test_pr_curve_and_area(pred):
    curve = m.threshold_curve(pred)
    pts = {r["threshold"]: (r["precision"], r["recall"]) for r in m.pr_curve(curve).collect()}
    assert pts[0.9] == (1.0, 0.25)
    assert pts[0.7] == (0.6, 0.75)
    rec = [0, 0.25, 0.25, 0.75, 0.75, 1.0, 1.0]
    pre = [1, 1, 0.5, 0.6, 0.5, 4 / 7, 0.5]
    want = sum((rec[i] - rec[i - 1]) * (pre[i] + pre[i - 1]) / 2 for i in range(1, len(rec)))
    assert m.pr_area(curve).first()["pr_auc"] == pytest.approx(want)


def test_best_threshold_and_strict_cut(pred, spark):
    """Labels are cut strictly above the best threshold, so its own rows are not called."""
    best = m.best_f1(m.pr_curve(m.threshold_curve(pred))).first()
    # 0.2 gives F1 8/11; 0.7 gives 2/3
    assert best["best_threshold"] == 0.2
    sizes = spark.createDataFrame([(i, 1 + i) for i in range(len(SCORES))], "id int, lines bigint")
    row = m.metric_table(pred, sizes).first()
    assert row["threshold"] == 0.2
    assert row["recall"] == 0.75 and row["precision"] == 0.5
    assert m.metric_table(pred, sizes, inclusive=True).first()["recall"] == 1.0


def test_gain_curve_ends_at_full_and_ideal_is_one(pred):
    sized = pred.withColumn("size", F.col("id") + 1)
    end = m.gain_curve(sized, "size").orderBy(F.col("rank").desc()).first()
    assert (end["x"], end["y"]) == pytest.approx((100.0, 100.0))
    ideal = pred.withColumn("y_pred", F.col("y_true").cast("double"))
    assert m.normalised_gain(ideal, {"g": F.lit(1)}).first()["g"] == pytest.approx(1.0)


def test_one_class_only(spark):
    one = spark.createDataFrame([("m", 1, 0, 0.1), ("m", 2, 0, 0.9)], "model string, id int, y_true int, y_pred double")
    curve = m.threshold_curve(one)
    assert m.roc_area(curve).first()["roc_auc"] is None
    assert m.best_f1(m.pr_curve(curve)).count() == 0


def test_confusion_inclusive_and_strict(pred):
    at = m.confusion(pred, 0.7).first()
    above = m.confusion(pred, 0.7, inclusive=False).first()
    assert (at["tp"], at["fp"], at["fn"], at["tn"]) == (3, 2, 1, 2)
    assert (above["tp"], above["fp"], above["fn"], above["tn"]) == (1, 1, 3, 3)


def test_threshold_sweep_equals_counting(pred):
    got = {round(r["threshold"], 6): (r["tp"], r["fp"]) for r in m.threshold_sweep(pred, 0.0, 1.0, 20).collect()}
    for cut, pair in got.items():
        want = (sum(t == 1 and p > cut + 1e-12 for t, p in SCORES), sum(t == 0 and p > cut + 1e-12 for t, p in SCORES))
        assert pair == want, cut


def test_focal_loss_bounds(spark):
    p = spark.createDataFrame([("m", 1, 1.0), ("m", 0, 0.0), ("m", 1, 0.0)], "model string, y_true int, y_pred double")
    r = [x["focal_loss"] for x in m.losses(p, alpha=0.25).collect()]
    assert sorted(r) == pytest.approx([0.0, 0.0, 25.0])
    assert max(x["log_loss"] for x in m.losses(p).collect()) == pytest.approx(11.512925, abs=1e-5)


def test_paired_difference_texts(spark):
    t = spark.createDataFrame([("a", 0.5), ("b", 0.75), ("c", 0.25)], "model string, auc double")
    got = {r["model"]: r["auc"] for r in m.paired_difference(t, "a", ["auc"]).collect()}
    assert got == {"a": "0.500", "b": "0.750 (+0.250)", "c": "0.250 (-0.250)"}
