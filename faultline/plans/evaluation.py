"""Scored changes: curves, areas, thresholds, gain and comparison tables."""

from pyspark.sql import functions as F

from faultline.functions.columns import big, r6
from faultline.operators import metrics as m
from faultline.plans.registry import VIEWS, query

# --- oracle-only views ---------------------------------------------------------------------------
VIEWS["o_curve"] = """
SELECT s.model, s.y_pred AS threshold,
       sum(s.pos) OVER (PARTITION BY s.model ORDER BY s.y_pred DESC) AS tp,
       sum(s.neg) OVER (PARTITION BY s.model ORDER BY s.y_pred DESC) AS fp,
       s.pos AS d_tp, s.neg AS d_fp, t.n_pos, t.n_neg
FROM (SELECT model, y_pred, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {v_predictions} GROUP BY 1, 2) s
JOIN (SELECT model, sum(y_true) AS n_pos, sum(1 - y_true) AS n_neg FROM {v_predictions} GROUP BY 1) t USING (model)"""

VIEWS["o_pr"] = """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1
FROM (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / n_pos AS recall FROM {o_curve})"""

VIEWS["o_pr_auc"] = """
SELECT model, sum((recall - r0) * (precision + p0) / 2) AS pr_auc FROM (
  SELECT model, recall, precision, lag(recall, 1, 0.0) OVER w AS r0, lag(precision, 1, 1.0) OVER w AS p0
  FROM {o_pr} WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)) GROUP BY model"""

VIEWS["o_best"] = """
SELECT model, threshold AS best_threshold, f1 AS best_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rn FROM {o_pr} WHERE f1 IS NOT NULL)
WHERE rn = 1"""

VIEWS["o_roc_full"] = """
SELECT model, threshold, CAST(tp AS DOUBLE) / n_pos AS tpr, CAST(fp AS DOUBLE) / n_neg AS fpr, d_tp, d_fp,
       row_number() OVER w AS rn, lead(d_tp) OVER w AS n_tp, lead(d_fp) OVER w AS n_fp
FROM {o_curve} WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)"""

VIEWS["o_roc"] = """
SELECT * FROM {o_roc_full} WHERE rn = 1 OR n_tp IS NULL OR n_tp <> d_tp OR n_fp <> d_fp"""

# rank form: independent of the curve used by the query
VIEWS["o_roc_auc"] = """
SELECT model, (sum(CASE WHEN y_true = 1 THEN avg_rank ELSE 0 END) - np * (np + 1) / 2.0) / (np * nn) AS roc_auc
FROM (SELECT p.model, p.y_true, rank() OVER (PARTITION BY p.model ORDER BY p.y_pred)
             + (count(*) OVER (PARTITION BY p.model, p.y_pred) - 1) / 2.0 AS avg_rank,
             sum(p.y_true) OVER (PARTITION BY p.model) AS np,
             sum(1 - p.y_true) OVER (PARTITION BY p.model) AS nn
      FROM {v_predictions} p)
GROUP BY model, np, nn"""

VIEWS["o_gain_in"] = """
SELECT p.model, p.id, p.y_true, p.y_pred, 'plain' AS kind, 1 AS size FROM {v_predictions} p
UNION ALL
SELECT p.model, p.id, p.y_true, p.y_pred, 'sized' AS kind, s.lines AS size
FROM {v_predictions} p JOIN {v_sizes} s ON p.id = s.id WHERE s.lines <= 2000"""

VIEWS["o_gain_curve"] = """
SELECT model, kind, ordering, id, rn,
       100.0 * sum(size) OVER w / sum(size) OVER t AS x,
       100.0 * sum(size * y_true) OVER w / sum(size * y_true) OVER t AS y
FROM (SELECT *, row_number() OVER (PARTITION BY model, kind, ordering ORDER BY score DESC, size, id) AS rn
      FROM (SELECT *, 'got' AS ordering, y_pred AS score FROM {o_gain_in}
            UNION ALL SELECT *, 'ideal' AS ordering, CAST(y_true AS DOUBLE) AS score FROM {o_gain_in}))
WINDOW w AS (PARTITION BY model, kind, ordering ORDER BY rn ROWS UNBOUNDED PRECEDING),
       t AS (PARTITION BY model, kind, ordering)"""

VIEWS["o_gain_area"] = """
SELECT model, kind, ordering, sum((x - x0) * (y + y0) / 2 / 100) AS area
FROM (SELECT model, kind, ordering, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM {o_gain_curve}
      WINDOW w AS (PARTITION BY model, kind, ordering ORDER BY rn)) GROUP BY 1, 2, 3"""

VIEWS["o_gain_norm"] = """
SELECT a.model, a.kind, a.area / b.area AS gain FROM {o_gain_area} a JOIN {o_gain_area} b
ON a.model = b.model AND a.kind = b.kind AND a.ordering = 'got' AND b.ordering = 'ideal'"""

VIEWS["o_point"] = """
SELECT p.model, b.best_threshold AS threshold,
       sum(CASE WHEN y_pred > best_threshold AND y_true = 1 THEN 1 ELSE 0 END) AS tp,
       sum(CASE WHEN y_pred > best_threshold AND y_true = 0 THEN 1 ELSE 0 END) AS fp,
       sum(CASE WHEN y_pred <= best_threshold AND y_true = 1 THEN 1 ELSE 0 END) AS fn
FROM {v_predictions} p JOIN {o_best} b ON p.model = b.model GROUP BY 1, 2"""

VIEWS["o_metric_table"] = """
SELECT p.model, p.threshold, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall,
       2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1, pa.pr_auc, ra.roc_auc, g1.gain AS gain_auc, g2.gain AS gain_norm_auc,
       fp_at.fpr_at_tpr
FROM {o_point} p JOIN {o_pr_auc} pa ON p.model = pa.model JOIN {o_roc_auc} ra ON p.model = ra.model
JOIN {o_gain_norm} g1 ON p.model = g1.model AND g1.kind = 'plain'
JOIN {o_gain_norm} g2 ON p.model = g2.model AND g2.kind = 'sized'
JOIN (SELECT model, arg_min(fpr, rn) AS fpr_at_tpr FROM {o_roc} WHERE tpr >= 0.95 GROUP BY model) fp_at ON p.model = fp_at.model"""

METRICS = "threshold precision recall f1 pr_auc roc_auc gain_auc gain_norm_auc fpr_at_tpr".split()


@query(
    "q_metric_table",
    "SELECT model, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)
    + " FROM {o_metric_table}",
)
def q_metric_table(t):
    out = m.metric_table(t.v_predictions, t.v_sizes)
    return out.select("model", *[r6(c, c) for c in METRICS])


@query(
    "q_pr_curve",
    """SELECT model, round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
    round(precision, 6) AS precision, round(recall, 6) AS recall FROM {o_pr}""",
)
def q_pr_curve(t):
    pr = m.pr_curve(m.threshold_curve(t.v_predictions))
    return pr.select(
        "model", r6("threshold", "threshold"), "tp", "fp", r6("precision", "precision"), r6("recall", "recall")
    )


@query(
    "q_roc_curve",
    """SELECT r.model, round(r.threshold, 6) AS threshold, round(r.tpr, 6) AS tpr, round(r.fpr, 6) AS fpr,
    round(j.j, 6) AS youden_j FROM {o_roc} r JOIN (SELECT model, max(tpr - fpr) AS j FROM {o_roc} GROUP BY model) j
    ON r.model = j.model""",
)
def q_roc_curve(t):
    roc = m.roc_curve(m.threshold_curve(t.v_predictions))
    best = m.youden_threshold(roc).select("model", "youden_j")
    return roc.join(best, "model").select(
        "model", r6("threshold", "threshold"), r6("tpr", "tpr"), r6("fpr", "fpr"), r6("youden_j", "youden_j")
    )


@query(
    "q_gain_curve",
    """SELECT g.model, g.id, CAST(g.rn AS BIGINT) AS rank, round(g.x, 6) AS x, round(g.y, 6) AS y
    FROM {o_gain_curve} g WHERE kind = 'sized' AND ordering = 'got'""",
)
def q_gain_curve(t):
    sized = t.v_predictions.join(t.v_sizes.filter(F.col("lines") <= 2000), "id")
    return m.gain_curve(sized, "lines").select("model", "id", "rank", r6("x", "x"), r6("y", "y"))


@query(
    "q_gain_auc",
    """SELECT model, round(area, 6) AS gain_auc FROM {o_gain_area} WHERE kind = 'plain' AND ordering = 'got'""",
)
def q_gain_auc(t):
    pred = t.v_predictions.withColumn("one", F.lit(1))
    curve = m.gain_curve(pred, "one")
    area = m.trapezoid_area(curve, ["model"], "x", "y", ["rank"], "area")
    return area.select("model", r6(F.col("area") / 100, "gain_auc"))


@query(
    "q_gain_norm",
    """SELECT model, round(max(CASE WHEN kind = 'plain' THEN gain END), 6) AS gain_auc,
    round(max(CASE WHEN kind = 'sized' THEN gain END), 6) AS gain_norm_auc FROM {o_gain_norm} GROUP BY model""",
)
def q_gain_norm(t):
    sized = t.v_predictions.join(t.v_sizes.filter(F.col("lines") <= 2000), "id", "left")
    out = m.normalised_gain(sized, {"gain_auc": F.lit(1), "gain_norm_auc": F.col("lines")})
    return out.select("model", r6("gain_auc", "gain_auc"), r6("gain_norm_auc", "gain_norm_auc"))


@query("q_roc_auc", "SELECT model, round(roc_auc, 6) AS roc_auc FROM {o_roc_auc}")
def q_roc_auc(t):
    return m.roc_area(m.threshold_curve(t.v_predictions)).select("model", r6("roc_auc", "roc_auc"))


@query("q_pr_auc", "SELECT model, round(pr_auc, 6) AS pr_auc FROM {o_pr_auc}")
def q_pr_auc(t):
    return m.pr_area(m.threshold_curve(t.v_predictions)).select("model", r6("pr_auc", "pr_auc"))


@query(
    "q_best_f1",
    "SELECT model, round(best_threshold, 6) AS best_threshold, round(best_f1, 6) AS best_f1 FROM {o_best}",
)
def q_best_f1(t):
    best = m.best_f1(m.pr_curve(m.threshold_curve(t.v_predictions)))
    return best.select("model", r6("best_threshold", "best_threshold"), r6("best_f1", "best_f1"))


_CONFUSION = """SELECT model, count(*) FILTER (y_pred {op} 0.5 AND y_true = 1) AS tp,
    count(*) FILTER (y_pred {op} 0.5 AND y_true = 0) AS fp, count(*) FILTER (NOT y_pred {op} 0.5 AND y_true = 1) AS fn,
    count(*) FILTER (NOT y_pred {op} 0.5 AND y_true = 0) AS tn FROM {{v_predictions}} GROUP BY model"""

VIEWS["o_conf_ge"] = _CONFUSION.format(op=">=").replace("{{", "{").replace("}}", "}")
VIEWS["o_conf_gt"] = _CONFUSION.format(op=">").replace("{{", "{").replace("}}", "}")


@query(
    "q_confusion",
    """SELECT model, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
    round(fp / nullif(tp + fp, 0), 6) AS fdr, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM {o_conf_ge}""",
)
def q_confusion(t):
    s = m.with_point_scores(m.confusion(t.v_predictions, 0.5))
    return s.select(
        "model", "tp", "fp", "fn", "tn",
        r6("precision", "precision"), r6("recall", "recall"), r6("fdr", "fdr"), r6("accuracy", "accuracy"),
    )


_POINT = """SELECT model, '{rule}' AS rule, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM """


@query(
    "q_point_metrics",
    _POINT.format(rule="above") + "{o_conf_gt} UNION ALL " + _POINT.format(rule="at_least") + "{o_conf_ge}",
)
def q_point_metrics(t):
    pred = t.v_predictions
    both = None
    for rule, inclusive in (("above", False), ("at_least", True)):
        s = m.with_point_scores(m.confusion(pred, 0.5, inclusive)).select(
            "model", F.lit(rule).alias("rule"), r6("precision", "precision"), r6("recall", "recall"),
            r6("f1", "f1"), r6("accuracy", "accuracy"),
        )
        both = s if both is None else both.unionByName(s)
    return both


@query(
    "q_fbeta",
    """SELECT model, round(1.25 * p * r / nullif(0.25 * p + r, 0), 6) AS f_half,
    round(1.25 * p * r / nullif(sqrt(0.5) * p + r, 0), 6) AS f_half_root
    FROM (SELECT model, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM {o_conf_ge})""",
)
def q_fbeta(t):
    s = m.with_point_scores(m.confusion(t.v_predictions, 0.5))
    p, r = F.col("precision"), F.col("recall")
    return s.select(
        "model", r6(m.f_beta(p, r, 0.5), "f_half"), r6(m.f_beta(p, r, 0.5, root_beta=True), "f_half_root")
    )


@query(
    "q_fpr_at_tpr",
    """SELECT model, round(arg_min(fpr, rn), 6) AS fpr_at_tpr FROM {o_roc} WHERE tpr >= 0.8 GROUP BY model""",
)
def q_fpr_at_tpr(t):
    roc = m.roc_curve(m.threshold_curve(t.v_predictions))
    return m.fpr_at_tpr(roc, 0.8).select("model", r6("fpr_at_tpr", "fpr_at_tpr"))


@query(
    "q_fdr_at_recall",
    """SELECT c.model, r.lvl / 10.0 AS recall_level, round(max(c.threshold), 6) AS threshold,
    round(arg_max(fp / (tp + fp), c.threshold), 6) AS fdr,
    round(arg_max((tp + n_neg - fp) / (n_pos + n_neg), c.threshold), 6) AS accuracy
    FROM {o_curve} c, (SELECT CAST(unnest(range(1, 10)) AS DOUBLE) AS lvl) r
    WHERE CAST(c.tp AS DOUBLE) / c.n_pos >= r.lvl / 10.0 GROUP BY 1, 2""",
)
def q_fdr_at_recall(t):
    levels = [i / 10 for i in range(1, 10)]
    out = m.threshold_at_recall(m.threshold_curve(t.v_predictions), levels)
    return out.select(
        "model", "recall_level", r6("threshold", "threshold"), r6("fdr", "fdr"), r6("accuracy", "accuracy")
    )


@query(
    "q_threshold_sweep",
    """SELECT model, round(-5 + i * 0.1, 6) AS threshold, count(*) FILTER (margin > -5 + i * 0.1 AND y_true = 1) AS tp,
    count(*) FILTER (margin > -5 + i * 0.1 AND y_true = 0) AS fp,
    round(coalesce(count(*) FILTER (margin > -5 + i * 0.1 AND y_true = 1) / nullif(count(*) FILTER (margin > -5 + i * 0.1), 0), 0), 6) AS precision,
    round(count(*) FILTER (margin > -5 + i * 0.1 AND y_true = 1) / sum(y_true), 6) AS recall
    FROM (SELECT model, y_true, 9.7 * y_pred - 4.8531 AS margin FROM {v_predictions}),
         (SELECT CAST(unnest(range(0, 100)) AS DOUBLE) AS i) GROUP BY model, i""",
)
def q_threshold_sweep(t):
    margins = t.v_predictions.withColumn("y_pred", 9.7 * F.col("y_pred") - 4.8531)
    return m.threshold_sweep(margins, -5.0, 5.0, 100).select(
        "model", r6("threshold", "threshold"), "tp", "fp", r6("precision", "precision"), r6("recall", "recall")
    )


@query(
    "q_sigmoid",
    "SELECT model, id, round(1 / (1 + exp(-(4 * y_pred - 2))), 6) AS y_pred FROM {v_predictions}",
)
def q_sigmoid(t):
    return t.v_predictions.select("model", "id", r6(m.sigmoid(4 * F.col("y_pred") - 2), "y_pred"))


@query(
    "q_minmax",
    """SELECT model, id, round((y_pred - min(y_pred) OVER w) / (max(y_pred) OVER w - min(y_pred) OVER w), 6) AS y_pred
    FROM {v_predictions} WINDOW w AS (PARTITION BY model)""",
)
def q_minmax(t):
    return m.min_max_scale(t.v_predictions, "y_pred", ["model"]).select("model", "id", r6("y_pred", "y_pred"))


@query(
    "q_zscale",
    """SELECT l_orderkey, l_partkey, l_linenumber,
    round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS z_quantity,
    round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS z_discount FROM lineitem""",
)
def q_zscale(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")
    z = m.z_scale(rows, ["l_quantity", "l_discount"])
    return z.select(
        "l_orderkey", "l_partkey", "l_linenumber", r6("l_quantity", "z_quantity"), r6("l_discount", "z_discount")
    )


@query(
    "q_losses",
    """SELECT model, round(avg(ll), 6) AS log_loss, round(avg(a * pow(1 - pt, 2) * ce), 6) AS focal_loss FROM (
      SELECT model, -(y * ln(greatest(least(p, 1 - 1e-5), 1e-5)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-5), 1e-5))) AS ll,
        CASE WHEN y = 1 THEN p ELSE 1 - p END AS pt, CASE WHEN y = 1 THEN 1 - rate ELSE rate END AS a,
        CASE WHEN y = 1 THEN CASE WHEN p <= 0 THEN 100 ELSE least(-ln(p), 100) END
             ELSE CASE WHEN p >= 1 THEN 100 ELSE least(-ln(1 - p), 100) END END AS ce
      FROM (SELECT model, y_true AS y, y_pred AS p, avg(y_true) OVER (PARTITION BY model) AS rate FROM {v_predictions}))
    GROUP BY model""",
)
def q_losses(t):
    rows = m.losses(t.v_predictions)
    return rows.groupBy("model").agg(r6(F.avg("log_loss"), "log_loss"), r6(F.avg("focal_loss"), "focal_loss"))


_DIFF = ", ".join(
    f"CASE WHEN t.model = 'm1' THEN printf('%.3f', t.{c}) ELSE printf('%.3f', t.{c}) || ' (' || "
    f"CASE WHEN t.{c} - b.{c} > 0 THEN '+' ELSE '' END || printf('%.3f', t.{c} - b.{c}) || ')' END AS {c}"
    for c in ("roc_auc", "pr_auc", "gain_auc")
)


@query(
    "q_metric_diff",
    "SELECT t.model, " + _DIFF + " FROM {o_metric_table} t, (SELECT * FROM {o_metric_table} WHERE model = 'm1') b",
)
def q_metric_diff(t):
    curve = m.threshold_curve(t.v_predictions)
    plain = m.normalised_gain(t.v_predictions, {"gain_auc": F.lit(1)})
    table = m.roc_area(curve).join(m.pr_area(curve), "model").join(plain, "model")
    return m.paired_difference(table, "m1", ["roc_auc", "pr_auc", "gain_auc"])


@query(
    "q_model_matrix",
    """WITH a AS (SELECT model, source, (sum(CASE WHEN y_true = 1 THEN rk ELSE 0 END) - np * (np + 1) / 2.0) / nullif(np * nn, 0) AS auc
      FROM (SELECT p.model, d.source, p.y_true, rank() OVER (PARTITION BY p.model, d.source ORDER BY p.y_pred)
              + (count(*) OVER (PARTITION BY p.model, d.source, p.y_pred) - 1) / 2.0 AS rk,
              sum(p.y_true) OVER (PARTITION BY p.model, d.source) AS np, sum(1 - p.y_true) OVER (PARTITION BY p.model, d.source) AS nn
            FROM {v_predictions} p JOIN documents d ON p.id = d.doc_id) GROUP BY model, source, np, nn)
    SELECT model, source AS project, round(auc, 6) AS auc, round(avg(auc) OVER (PARTITION BY model), 6) AS macro_auc FROM a""",
)
def q_model_matrix(t):
    # one curve for all (model, project) pairs: the pair plays the model
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("project"))
    pred = t.v_predictions.join(docs, "id")
    paired = pred.withColumn("model", F.struct("model", "project"))
    auc = m.roc_area(m.threshold_curve(paired)).select("model.model", "model.project", "roc_auc")
    macro = auc.groupBy("model").agg(F.avg("roc_auc").alias("macro"))
    return auc.join(macro, "model").select("model", "project", r6("roc_auc", "auc"), r6("macro", "macro_auc"))


@query(
    "q_unpivot_mean",
    """WITH w AS (SELECT d.source, avg(s.m1) AS m1, avg(s.m2) AS m2 FROM {v_scored} s JOIN documents d ON s.id = d.doc_id GROUP BY 1),
    l AS (SELECT 'm1' AS feature, source AS project, m1 AS value FROM w UNION ALL SELECT 'm2', source, m2 FROM w)
    SELECT feature, project, round(value, 6) AS value FROM l
    UNION ALL SELECT feature, 'mean', round(avg(value), 6) FROM l GROUP BY feature""",
)
def q_unpivot_mean(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("project"))
    wide = t.v_scored.join(docs, "id").groupBy("project").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2"))
    long = wide.unpivot("project", ["m1", "m2"], "feature", "value")
    mean = long.groupBy("feature").agg(F.avg("value").alias("value")).withColumn("project", F.lit("mean"))
    return long.unionByName(mean).select("feature", "project", r6("value", "value"))


@query(
    "q_score_fusion",
    """SELECT id, y_true, round(m1 + m2, 6) AS fused, CASE WHEN m1 + m2 > 1 THEN 1 ELSE 0 END AS called FROM {v_scored}""",
)
def q_score_fusion(t):
    pred = t.v_predictions
    first = pred.filter(F.col("model") == "m1").select("id", "y_true", F.col("y_pred").alias("a"))
    second = pred.filter(F.col("model") == "m2").select("id", F.col("y_pred").alias("b"))
    total = F.col("a") + F.col("b")
    return first.join(second, "id").select(
        "id", "y_true", r6(total, "fused"), (total > 1).cast("int").alias("called")
    )
