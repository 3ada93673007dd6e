"""Exact ranks, splits, folds, oversampling, quantiles and metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import metrics as met
from retentio.operators import sampling as smp
from retentio.operators.label import require_two_classes
from retentio.operators.quantiles import exact_percentiles
from retentio.operators.ranking import bucketed_rank


def _labelled(spark, n=3000, pos_every=7):
    return spark.range(n).select(F.col("id").cast("string").alias("customer_id"),
                                 (F.col("id") % pos_every == 0).cast("int").alias("is_at_risk"))


def test_bucketed_rank_equals_window(spark):
    df = _labelled(spark)
    bucketed_rank(df, "is_at_risk", "customer_id").createOrReplaceTempView("rk")
    bad = spark.sql("""select count(*) from (select rank, row_number() over (partition by is_at_risk
                       order by md5(concat(customer_id, ':42')), customer_id) - 1 as r2 from rk) where rank <> r2""")
    assert bad.first()[0] == 0


def test_split_counts_are_exact(spark):
    s = smp.stratified_split(_labelled(spark))
    got = {(r.is_at_risk, r.split): r["count"] for r in s.groupBy("is_at_risk", "split").count().collect()}
    n1 = 3000 // 7 + 1
    assert got[(1, "test")] == int(np.floor(n1 * 0.2 + 0.5))
    assert got[(0, "test")] == int(np.floor((3000 - n1) * 0.2 + 0.5))


def test_folds_are_disjoint_complete_and_stratified(spark):
    f = smp.stratified_folds(_labelled(spark))
    assert f.count() == 3000 and f.select("customer_id").distinct().count() == 3000
    sizes = [r["count"] for r in f.where("is_at_risk = 1").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_oversample_balances_and_keeps_originals(spark):
    df = _labelled(spark)
    o = smp.oversample(df)
    counts = {r.is_at_risk: r["count"] for r in o.groupBy("is_at_risk").count().collect()}
    assert counts[0] == counts[1] == 3000 - (3000 // 7 + 1)
    assert o.where("draw is null").count() == 3000
    extras = o.where("draw is not null")
    assert extras.where("is_at_risk = 0").count() == 0
    assert extras.join(df.where("is_at_risk = 1"), ["customer_id", "is_at_risk"], "left_anti").count() == 0


def test_class_weights_balanced(spark):
    w = {r.is_at_risk: r.weight for r in smp.class_weights(_labelled(spark, 10, 5)).distinct().collect()
         if True}
    assert w[1] == pytest.approx(10 / (2 * 2)) and w[0] == pytest.approx(10 / (2 * 8))


def test_single_class_is_an_error(spark):
    with pytest.raises(ValueError):
        require_two_classes(_labelled(spark).withColumn("is_at_risk", F.lit(0)))


def test_pr_auc_closes_at_precision_one(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.1, 1)], "score double, label int")
    assert met.pr_auc(df).first()[0] == pytest.approx(0.6667)


def test_roc_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.1, 1), (0.05, 0)], "score double, label int")
    assert met.roc_auc(df).first()[0] == pytest.approx(0.625)
    assert met.roc_auc(df.where("label = 1")).first()[0] is None


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    r = {x["class"]: x for x in met.classification_report(df).collect()}
    assert r["1"].precision == 1.0 and r["1"].recall == 0.5 and r["0"].precision == pytest.approx(0.6667)
    assert r["accuracy"].f1_score == 0.75 and r["accuracy"].support == 4


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 2000).round(3), np.full(1500, 0.5)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = exact_percentiles(df, "v", [0.1, 0.5, 0.9], names=["a", "b", "c"], buckets=32).first()
    assert list(got) == pytest.approx(list(np.quantile(vals, [0.1, 0.5, 0.9])))


def test_report_takes_null_as_one_class(spark):
    from retentio.operators.metrics import classification_report
    df = spark.createDataFrame([(1, 1), (1, None), (None, None), (None, None), (None, 1), (0, 0)], "label int, prediction int")
    r = {x["class"]: x for x in classification_report(df, "label", "prediction").collect()}
    assert len(r) == 6 and r[None]["support"] == 3
    assert r[None]["precision"] == r[None]["recall"] == 0.6667 and r["1"]["precision"] == 0.5 and r["accuracy"]["f1_score"] == 0.6667
