"""End to end through the job entry points: CSV inputs -> train -> artifact
-> score -> predictions CSV."""

import os

import pytest

from retentio.sources import driver

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _csv(df, path):
    df.write.option("header", "true").option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def test_train_then_score_from_csv(spark, tmpdir_path):
    from retentio.plans import scoring, training
    from retentio.sources.tables import read_table
    o, d, f = (f"{tmpdir_path}/{n}" for n in ("orders", "delivery", "feedback"))
    _csv(driver.orders(spark, SF), o)
    _csv(driver.delivery(spark, SF).drop("order_id", "line_number"), d)
    _csv(driver.feedback(spark, SF).drop("feedback_id"), f)
    model = f"{tmpdir_path}/model"
    args = ["--orders", o, "--delivery", d, "--feedback", f, "--as-of", "2001-08-02 00:00:00", "--format", "csv"]
    training.main(args + ["--model", model, "--n_estimators", "10", "--max_depth", "4"])
    out = f"{tmpdir_path}/predictions"
    tables = f"{tmpdir_path}/tables"
    scoring.main(args + ["--model", model, "--out", out, "--tables-out", tables])
    p = read_table(spark, out, fmt="csv")
    assert p.count() == 150
    cols = set(p.columns)
    assert {"risk_score", "risk_label", "avg_rating", "negative_feedback_count", "emb_0", "emb_63"} <= cols
    assert p.where("risk_score < 0 or risk_score > 1").count() == 0
    for name in ("filter_domain", "risk_distribution", "scatter_sample", "monetary_box", "correlation",
                 "top_at_risk", "top_interventions", "orders_trend"):
        assert spark.read.parquet(f"{tables}/{name}").count() > 0, name


def test_score_without_model_gives_unknown_and_all_tables(spark, tmpdir_path):
    from retentio.plans import scoring
    o, f = f"{tmpdir_path}/orders", f"{tmpdir_path}/feedback"
    driver.orders(spark, SF).write.parquet(o)
    driver.feedback(spark, SF).write.parquet(f)
    out, tables = f"{tmpdir_path}/pred", f"{tmpdir_path}/tables"
    scoring.main(["--orders", o, "--feedback", f, "--out", out, "--tables-out", tables,
                  "--as-of", "2001-08-02 00:00:00"])
    p = spark.read.option("header", True).csv(out)
    assert p.count() == 150 and {r.risk_label for r in p.select("risk_label").collect()} == {"Unknown"}
    corr = spark.read.parquet(f"{tables}/correlation")
    assert corr.where("feature_x = 'risk_score' and feature_y = 'recency'").first().corr is None
