"""Evaluation metrics on (label, score, prediction) frames: PR curve and its
area (M10), ROC AUC (M11) and the classification report (M12).

Scores are first collapsed to one row per distinct score with positive and
negative counts (partial aggregation), then the exact cumulative counts come
from ``running_totals`` over score buckets — no global sort in one task and
no ``collect``.  Results are one-row (or few-row) DataFrames.  A NULL score is an
error, not a row to leave out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators.ranking import quantile_bucket, running_totals


def _score_counts(df: DataFrame, label: str, score: str, descending: bool) -> DataFrame:
    s = F.coalesce(F.col(score).cast("double"), F.raise_error(F.lit(f"{score!r} holds NULL")).cast("double"))
    g = (df.groupBy(s.alias("_s"))
         .agg(F.count_if(F.col(label) == 1).cast("bigint").alias("_pos"),
              F.count_if(F.col(label) != 1).cast("bigint").alias("_neg")))
    # order key: ascending score, or descending via negation
    g = g.withColumn("_o", -F.col("_s") if descending else F.col("_s"))
    g = quantile_bucket(g, "_o")
    return running_totals(g, ["_o"], ["_pos", "_neg"], bucket="_b", with_totals=True)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """threshold, precision, recall at every distinct score (descending
    thresholds), as in a precision-recall curve; the closing point
    (recall 0, precision 1) is implicit."""
    c = _score_counts(df, label, score, descending=True)
    tp, fp = F.col("_pos_cum"), F.col("_neg_cum")
    return c.select(F.col("_s").alias("threshold"),
                    F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
                    F.coalesce(F.try_divide(tp, F.col("_pos_total")), F.lit(1.0)).alias("recall"))


def pr_auc(df: DataFrame, label: str = "label", score: str = "score", digits: int = 4) -> DataFrame:
    """Trapezoidal area under the PR curve, closed at (recall 0, precision 1)."""
    c = _score_counts(df, label, score, descending=True)
    tp, fp = F.col("_pos_cum"), F.col("_neg_cum")
    tp0, fp0 = tp - F.col("_pos"), fp - F.col("_neg")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    prec0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    # recall steps are pos / P, so the area is sum(pos * mean precision) / P
    area = F.try_divide(F.sum(F.col("_pos") * (prec + prec0) / 2.0), F.sum("_pos"))
    return c.agg(F.round(area, digits).alias("pr_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", digits: int = 4) -> DataFrame:
    """Area under the ROC curve (ties count one half); NULL when a class is absent."""
    c = _score_counts(df, label, score, descending=False)
    neg_below = F.col("_neg_cum") - F.col("_neg")
    return c.agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"),
                 F.sum(F.col("_pos") * (neg_below + F.col("_neg") * 0.5)).alias("_U")).select(
        F.when((F.col("_P") > 0) & (F.col("_N") > 0),
               F.round(F.col("_U") / (F.col("_P") * F.col("_N")), digits)).alias("roc_auc"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          digits: int = 4) -> DataFrame:
    """class, precision, recall, f1_score, support for each class, then
    'accuracy' (value in f1_score), 'macro avg' and 'weighted avg'.
    A zero division gives 0; NULL is a class like any other."""
    lab = F.col(label).cast("string")
    pred = F.col(prediction).cast("string")
    conf = df.groupBy(lab.alias("_l"), pred.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    # confusion table: at most k*k rows
    zero = F.lit(0).cast("bigint")
    as_label = F.struct(F.col("_l").alias("class"), F.col("_c").alias("support"), zero.alias("_npred"),
                        F.when(F.col("_l").eqNullSafe(F.col("_p")), F.col("_c")).otherwise(zero).alias("_tp"))
    as_prediction = F.struct(F.col("_p").alias("class"), zero.alias("support"), F.col("_c").alias("_npred"), zero.alias("_tp"))
    per = (conf.select(F.inline(F.array(as_label, as_prediction)))
           .groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "_npred", "_tp")]))
    prec = F.when(F.col("_npred") > 0, F.col("_tp") / F.col("_npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("_tp") / F.col("support")).otherwise(0.0)
    per = per.withColumns({"precision": prec, "recall": rec})
    per = per.withColumn("f1_score", F.when(F.col("precision") + F.col("recall") > 0,
                                            2 * F.col("precision") * F.col("recall")
                                            / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    total = F.sum("support")
    summary = per.agg(
        (F.sum("_tp") / total).alias("acc"), total.alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / total).alias("wf"))
    def row(name, p, r, f):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        F.col("n").cast("bigint").alias("support"))

    rows = summary.select(F.inline(F.array(
        row("accuracy", F.lit(None), F.lit(None), F.col("acc")),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))))
    out = per.select("class", "precision", "recall", "f1_score",
                     F.col("support").cast("bigint").alias("support")).unionByName(rows)
    return out.select("class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("bigint").alias("support"))
