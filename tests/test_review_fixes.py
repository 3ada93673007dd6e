"""Cases the driver tables do not reach: NaN, odd keys, damaged models, null labels and scores."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from retentio.functions.columns import exact_mean
from retentio.operators import features as feat
from retentio.operators import metrics as met
from retentio.operators import sampling as smp
from retentio.operators.model import ModelOptions, build_pipeline, feature_columns, load_model, median_imputer
from retentio.sources.tables import read_table


def test_mean_skips_nan_and_keeps_small_and_huge_values(spark):
    rows = [("a", float("nan")), ("a", 4.0), ("b", 1e-7), ("b", 3e-7), ("c", 1e33), ("d", None), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(exact_mean("v").alias("m")).collect()}
    assert got["a"] == 4.0 and got["b"] == pytest.approx(2e-7, rel=1e-12) and got["c"] == 1e33
    assert got["d"] is None and got["e"] is None


def test_mean_just_above_a_threshold_stays_above(spark):
    df = spark.range(3_000_000).select(F.when(F.col("id") == 0, 3.0).otherwise(2.0).alias("r"))
    assert df.agg((exact_mean("r") <= 2).alias("low")).first().low is False


def test_default_as_of_is_now(spark):
    o = spark.createDataFrame([("1", 1, 5.0)], "customer_id string, order_id long, order_value double").withColumn(
        "order_date", F.current_timestamp() - F.expr("INTERVAL 3 DAYS"))
    assert feat.tabular_features(o).first().recency == 3


def test_tabular_features_run_no_job_when_called(spark):
    o = spark.createDataFrame([("1", 1, 5.0, "2001-01-01")], "customer_id string, order_id long, order_value double, order_date string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy-features", "no job")
    feat.tabular_features(o, as_of="2001-02-01")
    assert list(tracker.getJobIdsForGroup("lazy-features")) == []


def test_keys_stay_text_and_rows_keep_file_order(spark, tmp_path):
    folder = tmp_path / "f.csv"
    folder.mkdir()
    for i, n in enumerate((2, 5, 300)):  # the last file is the largest
        lines = [f"{'007' if j % 2 else '7'},f{i}-{j},12345678901234567890{j % 10}" for j in range(n)]
        pathlib.Path(folder, f"part-{i}.csv").write_text("customer_id,feedback_text,other\n" + "\n".join(lines) + "\n")
    df = read_table(spark, str(folder), fmt="csv", row_id="feedback_id")
    assert {r.customer_id for r in df.collect()} == {"7", "007"}
    text = {r.customer_id: r.feedback_text for r in feat.feedback_text(df).collect()}
    assert text["7"].split(" ") == [f"f{i}-{j}" for i, n in enumerate((2, 5, 300)) for j in range(0, n, 2)]


def test_damaged_model_is_an_error_and_missing_one_is_none(spark, tmp_path):
    assert load_model(spark, f"{tmp_path}/none") is None
    with pytest.raises(FileNotFoundError):
        load_model(spark, f"{tmp_path}/none", required=True)
    os.makedirs(f"{tmp_path}/broken/pipeline")
    with pytest.raises(Exception):
        load_model(spark, f"{tmp_path}/broken")


def test_depth_beyond_spark_is_refused(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "recency double, is_at_risk double")
    with pytest.raises(ValueError):
        build_pipeline(df, ["recency"], ModelOptions(max_depth=50))
    assert ModelOptions().max_depth is None


def test_median_imputer_on_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "recency double, monetary double")
    stage, names = median_imputer(df, ["recency", "monetary"])
    got = sorted(tuple(r) for r in stage.transform(df).select(*names.values()).collect())
    assert got == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]


def test_null_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(str(i), None if i % 5 == 0 else i % 2) for i in range(50)], "customer_id string, is_at_risk int")
    assert smp.stratified_split(df).count() == smp.stratified_folds(df).count() == smp.class_weights(df).count() == 50
    over = smp.oversample(df)
    assert over.where("draw IS NULL").count() == 50
    assert {r["count"] for r in over.groupBy("is_at_risk").count().collect()} == {20}


def test_null_score_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.5), (0, None)], "label int, score double")
    with pytest.raises(Exception, match="holds NULL"):
        met.roc_auc(df).collect()


def test_excluded_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "recency double, monetary double, other double")
    assert feature_columns(df, ("recency",)) == ["monetary"]
