"""Quality of scored changes: curves, areas, thresholds and point metrics.

Input rows are ``(model, id, y_true, y_pred)``. Equal scores are counted together before anything is
ordered, so a curve costs one pass over the distinct scores of a model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.scan import (
    falling,
    following,
    ordered_scan,
    previous,
    row_number,
    running_sum,
)


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b as double; ``default`` where b is zero."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def score_counts(pred: DataFrame) -> DataFrame:
    """Positives and negatives per (model, score)."""
    return pred.groupBy("model", "y_pred").agg(
        F.sum(F.col("y_true").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("y_true")).cast("bigint")).alias("neg"),
    )


def class_totals(pred: DataFrame) -> DataFrame:
    return pred.groupBy("model").agg(
        F.sum(F.col("y_true").cast("bigint")).alias("n_pos"),
        F.sum((1 - F.col("y_true")).cast("bigint")).alias("n_neg"),
    )


def threshold_curve(pred: DataFrame) -> DataFrame:
    """Per (model, threshold): true and false positives when everything scored at or above it is
    called positive, with the step (``d_tp``, ``d_fp``) taken at that threshold."""
    counts = score_counts(pred)
    running = ordered_scan(
        counts,
        ["model"],
        [falling("y_pred")],
        {
            "tp": running_sum("pos"),
            "fp": running_sum("neg"),
            "place": row_number(),
            "next_step": following(F.struct(F.col("pos").alias("tp"), F.col("neg").alias("fp"))),
        },
        totals={"n_pos": running_sum("pos"), "n_neg": running_sum("neg")},
    )
    return running.select(
        "model",
        F.col("y_pred").alias("threshold"),
        "tp",
        "fp",
        F.col("pos").alias("d_tp"),
        F.col("neg").alias("d_fp"),
        "n_pos",
        "n_neg",
        "place",
        "next_step",
    )


def pr_curve(curve: DataFrame) -> DataFrame:
    """Precision, recall and F1 at every threshold."""
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("n_pos"))
    with_pr = curve.withColumn("precision", p).withColumn("recall", r)
    return with_pr.withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def _pr_area() -> Column:
    before_tp, before_fp = F.col("tp") - F.col("d_tp"), F.col("fp") - F.col("d_fp")
    before = ratio(before_tp, before_tp + before_fp, default=1.0)
    now = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return F.sum(ratio(F.col("d_tp"), F.col("n_pos")) * (now + before) / 2)


def _roc_area() -> Column:
    before = ratio(F.col("tp") - F.col("d_tp"), F.col("n_pos"))
    now = ratio(F.col("tp"), F.col("n_pos"))
    return F.sum(ratio(F.col("d_fp"), F.col("n_neg")) * (now + before) / 2)


def pr_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area under the PR curve; the curve starts at recall 0, precision 1."""
    return curve.groupBy("model").agg(_pr_area().alias("pr_auc"))


def roc_area(curve: DataFrame) -> DataFrame:
    """Area under the ROC curve: ties count half, as in the rank form."""
    return curve.groupBy("model").agg(_roc_area().alias("roc_auc"))


def _corner() -> Column:
    """The first and last point of a curve, and inner ones whose step differs from the next."""
    step = F.col("next_step")
    turns = (step["tp"] != F.col("d_tp")) | (step["fp"] != F.col("d_fp"))
    return (F.col("place") == 1) | step.isNull() | turns


def roc_curve(curve: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """True and false positive rates per threshold.

    ``drop_collinear`` leaves out inner points whose step equals the following step, which is how
    common ROC tools thin the curve; areas do not change, an FPR read off the curve may.
    """
    out = curve.filter(_corner()) if drop_collinear else curve
    return out.withColumn("tpr", ratio(F.col("tp"), F.col("n_pos"))).withColumn("fpr", ratio(F.col("fp"), F.col("n_neg")))


def fpr_at_tpr(roc: DataFrame, k: float, name: str = "fpr_at_tpr") -> DataFrame:
    """False positive rate at the first curve point whose true positive rate is at least ``k``."""
    return roc.groupBy("model").agg(
        F.min_by("fpr", F.when(F.col("tpr") >= k, F.col("place"))).alias(name)
    )


def youden_threshold(roc: DataFrame) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest threshold wins a tie."""
    j = F.col("tpr") - F.col("fpr")
    return roc.groupBy("model").agg(
        F.max_by("threshold", F.struct(j, F.col("threshold"))).alias("youden_threshold"),
        F.max(j).alias("youden_j"),
    )


def best_f1(pr: DataFrame) -> DataFrame:
    """Threshold with the largest F1; the lowest threshold wins a tie."""
    usable = pr.filter(F.col("f1").isNotNull())
    return usable.groupBy("model").agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("best_threshold"),
        F.max("f1").alias("best_f1"),
    )


def confusion(
    pred: DataFrame, threshold: Column | float, inclusive: bool = True, keys: Sequence[str] = ("model",)
) -> DataFrame:
    """TP, FP, FN, TN per key at ``threshold`` (a number or a column of ``pred``)."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    called = F.col("y_pred") >= cut if inclusive else F.col("y_pred") > cut
    pos = F.col("y_true") == 1
    return pred.groupBy(*keys).agg(
        F.count_if(called & pos).alias("tp"),
        F.count_if(called & ~pos).alias("fp"),
        F.count_if(~called & pos).alias("fn"),
        F.count_if(~called & ~pos).alias("tn"),
    )


def with_point_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and false discovery rate from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return (
        counts.withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn("f1", F.try_divide(2 * p * r, p + r))
        .withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("fdr", ratio(fp, tp + fp))
    )


def f_beta(precision: Column, recall: Column, beta: float, root_beta: bool = False) -> Column:
    """F-beta. ``root_beta`` weighs precision with the square root of beta, a variant in use."""
    weight = beta**0.5 if root_beta else beta**2
    return F.try_divide((1 + beta**2) * precision * recall, weight * precision + recall)


def gain_curve(pred: DataFrame, size: str, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Cumulative gain: highest score first, the smaller change first among equals, then the id.

    x is the share of size examined, y the share of positive size found, both in percent; ``d_x``
    and ``d_y`` are the steps of the row.
    """
    keys = list(keys)
    pos_size = F.col("y_true") * F.col(size)
    running = ordered_scan(
        pred,
        keys,
        [falling("y_pred"), size, "id"],
        {"rank": row_number(), "_seen": running_sum(size), "_found": running_sum(pos_size)},
        totals={"_size": running_sum(size), "_pos_size": running_sum(pos_size)},
    )
    return running.select(
        *pred.columns,
        "rank",
        (ratio(F.col("_seen"), F.col("_size")) * 100).alias("x"),
        (ratio(F.col("_found"), F.col("_pos_size")) * 100).alias("y"),
        (ratio(F.col(size), F.col("_size")) * 100).alias("d_x"),
        (ratio(pos_size, F.col("_pos_size")) * 100).alias("d_y"),
    )


def gain_area(curve: DataFrame, name: str, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Trapezoid area under the gain curve from its first point, as a share of 100 percent."""
    area = F.col("d_x") * (2 * F.col("y") - F.col("d_y")) / 2 / 100
    return curve.groupBy(*keys).agg(F.sum(F.when(F.col("rank") > 1, area).otherwise(0.0)).alias(name))


def trapezoid_area(points: DataFrame, keys: Sequence[str], x: str, y: str, order: Sequence, name: str) -> DataFrame:
    """Area under any ordered curve."""
    stepped = ordered_scan(
        points, keys, order, {"_x0": previous(x), "_y0": previous(y)}
    )
    step = (F.col(x) - F.col("_x0")) * (F.col(y) + F.col("_y0")) / 2
    return stepped.groupBy(*keys).agg(F.sum(F.coalesce(step, F.lit(0.0))).alias(name))


def normalised_gain(pred: DataFrame, sizes: dict[str, Column]) -> DataFrame:
    """Gain areas divided by the area of the ideal ordering (all positives first), one column per
    entry of ``sizes``; rows where a size is null are not part of that curve.

    All curves of a model, real and ideal, are laid next to each other and ordered in one pass.
    """
    variants = F.array(
        *[
            F.struct(F.lit(name).alias("kind"), F.lit(ideal).alias("ideal"), size.cast("bigint").alias("size"),
                     (F.col("y_true").cast("double") if ideal else F.col("y_pred").cast("double")).alias("y_pred"))
            for name, size in sizes.items()
            for ideal in (False, True)
        ]
    )
    rows = pred.select("model", "id", "y_true", F.inline(variants)).filter(F.col("size").isNotNull())
    keys = ["model", "kind", "ideal"]
    areas = gain_area(gain_curve(rows, "size", keys), "area", keys)
    pick = lambda name, ideal: F.max(F.when((F.col("kind") == name) & (F.col("ideal") == ideal), F.col("area")))
    return areas.groupBy("model").agg(*[F.try_divide(pick(n, False), pick(n, True)).alias(n) for n in sizes])


def metric_table(
    pred: DataFrame,
    sizes: DataFrame,
    fpr_at: float = 0.95,
    inclusive: bool = False,
    max_lines: int = 2000,
) -> DataFrame:
    """One row per model with every headline metric, from one pass over its curve and one over its
    gain rows.

    Labels are cut at the best-F1 threshold; ``inclusive=False`` calls only scores above it positive.
    """
    curve = pr_curve(threshold_curve(pred))
    tpr, fpr = ratio(F.col("tp"), F.col("n_pos")), ratio(F.col("fp"), F.col("n_neg"))
    # the point just above the best threshold leaves out the step taken at it
    called = F.struct(
        "threshold",
        (F.col("tp") if inclusive else F.col("tp") - F.col("d_tp")).alias("tp"),
        (F.col("fp") if inclusive else F.col("fp") - F.col("d_fp")).alias("fp"),
        "n_pos",
    )
    best_first = F.when(F.col("f1").isNotNull(), F.struct("f1", -F.col("threshold")))
    s = curve.groupBy("model").agg(
        F.max_by(called, best_first).alias("b"),
        _pr_area().alias("pr_auc"),
        _roc_area().alias("roc_auc"),
        F.min_by(fpr, F.when((tpr >= fpr_at) & _corner(), F.col("place"))).alias("fpr_at_tpr"),
    )
    p, r = ratio(F.col("b.tp"), F.col("b.tp") + F.col("b.fp")), ratio(F.col("b.tp"), F.col("b.n_pos"))
    known = sizes.filter(F.col("lines") <= max_lines)
    gains = normalised_gain(
        pred.join(known, "id", "left"), {"gain_auc": F.lit(1), "gain_norm_auc": F.col("lines")}
    )
    return s.join(gains, "model", "left").select(
        "model",
        F.col("b.threshold").alias("threshold"),
        p.alias("precision"),
        r.alias("recall"),
        F.try_divide(2 * p * r, p + r).alias("f1"),
        "pr_auc",
        "roc_auc",
        "gain_auc",
        "gain_norm_auc",
        "fpr_at_tpr",
    )


def threshold_at_recall(curve: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Per model and recall level: the highest threshold reaching it, with false discovery rate and
    accuracy when scores at or above it are called positive. One pass, one aggregate per level."""
    recall = ratio(F.col("tp"), F.col("n_pos"))
    state = F.struct("threshold", "tp", "fp", "n_pos", "n_neg")
    aggs = [
        F.max_by(state, F.when(recall >= lvl, F.col("threshold"))).alias(f"_l{i}")
        for i, lvl in enumerate(levels)
    ]
    rows = F.array(
        *[
            F.struct(F.lit(float(lvl)).alias("recall_level"), F.col(f"_l{i}").alias("s"))
            for i, lvl in enumerate(levels)
        ]
    )
    flat = curve.groupBy("model").agg(*aggs).select("model", F.inline(rows))
    tp, fp = F.col("s.tp"), F.col("s.fp")
    n_pos, n_neg = F.col("s.n_pos"), F.col("s.n_neg")
    return flat.select(
        "model",
        "recall_level",
        F.col("s.threshold").alias("threshold"),
        ratio(fp, tp + fp, default=0.0).alias("fdr"),
        ratio(tp + n_neg - fp, n_pos + n_neg).alias("accuracy"),
    )


def threshold_sweep(pred: DataFrame, low: float, high: float, steps: int) -> DataFrame:
    """Precision and recall for every cut ``low + i * (high - low) / steps`` (scores above the cut).

    Scores are counted into the grid cells once; a running sum over the cells answers every cut.
    """
    width = (high - low) / steps
    # cell i holds the scores that lie above cut i-1 and not above cut i
    cell = F.ceil((F.col("y_pred") - F.lit(low)) / F.lit(width))
    cell = F.least(F.greatest(cell, F.lit(0)), F.lit(steps)).cast("int")
    cells = (
        pred.groupBy("model", cell.alias("cell"))
        .agg(
            F.sum(F.col("y_true").cast("bigint")).alias("pos"),
            F.sum((1 - F.col("y_true")).cast("bigint")).alias("neg"),
        )
    )
    totals = class_totals(pred)
    # at most steps + 1 cells per model: collect them as a map and read every cut from it
    grid = totals.select("model", "n_pos", "n_neg", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("cell"))
    filled = grid.join(cells, ["model", "cell"], "left").na.fill(0, ["pos", "neg"])
    run = ordered_scan(
        filled, ["model"], ["cell"], {"_below_pos": running_sum("pos"), "_below_neg": running_sum("neg")}
    )
    tp, fp = F.col("n_pos") - F.col("_below_pos"), F.col("n_neg") - F.col("_below_neg")
    return run.select(
        "model",
        (F.lit(low) + F.col("cell") * F.lit(width)).alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        F.when(tp == 0, 0.0).otherwise(ratio(tp, tp + fp)).alias("precision"),
        F.when(tp == 0, 0.0).otherwise(ratio(tp, F.col("n_pos"))).alias("recall"),
    )


def losses(pred: DataFrame, alpha: float | None = None, gamma: float = 2.0) -> DataFrame:
    """Clamped log loss and focal loss per row. ``alpha=None`` takes 1 - positive rate of the model."""
    y, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    clamped = F.greatest(F.least(p, F.lit(1 - 1e-5)), F.lit(1e-5))
    log_loss = -(y * F.log(clamped) + (1 - y) * F.log(1 - clamped))
    if alpha is None:
        rates = pred.groupBy("model").agg((1 - F.avg("y_true")).alias("_alpha"))
        pred = pred.join(rates, "model")
        a = F.col("_alpha")
    else:
        a = F.lit(float(alpha))
    # binary cross entropy bounds its logarithms at -100
    floor = F.lit(-100.0)
    log_p = F.when(p <= 0, floor).otherwise(F.greatest(F.log(p), floor))
    log_q = F.when(p >= 1, floor).otherwise(F.greatest(F.log(1 - p), floor))
    cross = -(y * log_p + (1 - y) * log_q)
    pt = F.when(y == 1, p).otherwise(1 - p)
    weight = y * a + (1 - y) * (1 - a)
    return pred.withColumn("log_loss", log_loss).withColumn(
        "focal_loss", weight * F.pow(1 - pt, F.lit(float(gamma))) * cross
    )


def min_max_scale(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(x - min) / (max - min) over the key."""
    bounds = F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))
    if keys:
        lims = df.groupBy(*keys).agg(bounds.alias("_b"))
        out, b = df.join(lims, list(keys)), F.col("_b")
    else:
        out = df.withColumn("_b", df.agg(bounds).scalar())
        b = F.col("_b")
    scaled = F.try_divide(F.col(column) - b["lo"], b["hi"] - b["lo"])
    return out.withColumn(column, scaled).drop("_b")


def z_scale(df: DataFrame, columns: Sequence[str], moments: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation. ``moments`` names the rows the moments come from (train);
    a column without spread is only centred."""
    source = df if moments is None else moments
    stats = source.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        )
    ).scalar()
    out = df.withColumn("_m", stats)
    for c in columns:
        s = F.col("_m")[f"s_{c}"]
        out = out.withColumn(c, (F.col(c) - F.col("_m")[f"m_{c}"]) / F.when(s == 0, 1.0).otherwise(s))
    return out.drop("_m")


def sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def paired_difference(table: DataFrame, reference: str, metrics: Sequence[str]) -> DataFrame:
    """Three-digit texts; every other model also shows its signed distance to ``reference``."""
    base = table.filter(F.col("model") == reference).select(F.struct(*metrics)).scalar()
    out = table.withColumn("_base", base)
    cols = []
    for m in metrics:
        gap = F.col(m) - F.col("_base")[m]
        text = F.format_string("%.3f", F.col(m))
        sign = F.when(gap > 0, "+").otherwise("")
        moved = F.concat(text, F.lit(" ("), sign, F.format_string("%.3f", gap), F.lit(")"))
        cols.append(F.when(F.col("model") == reference, text).otherwise(moved).alias(m))
    return out.select("model", *cols)
