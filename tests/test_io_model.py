"""CSV round trip, string/integer keys, and model train/save/load."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators.features import tabular_features
from retentio.operators.model import ModelMeta, ModelOptions, fit, load_model, predict, save_model
from retentio.sources.tables import read_table, write_predictions


def test_csv_quotes_and_newlines_round_trip(spark, tmpdir_path):
    text = 'he said "bad", then\nleft'
    df = spark.createDataFrame([("1", text, 2.0), ("2", "", None)], "customer_id string, feedback_text string, rating double")
    path = f"{tmpdir_path}/out"
    write_predictions(df, path)
    back = read_table(spark, path, fmt="csv")
    rows = {r.customer_id: r for r in back.collect()}
    assert len(rows) == 2 and rows["1"].feedback_text == text and rows["1"].rating == 2.0
    assert rows["2"].rating is None


def test_missing_optional_table_is_none(spark, tmpdir_path):
    assert read_table(spark, f"{tmpdir_path}/nope.csv", optional=True) is None


def test_integer_and_string_keys_match(spark, tmpdir_path):
    p = f"{tmpdir_path}/fb.parquet"
    spark.createDataFrame([(1, 1.0)], "customer_id long, rating double").write.parquet(p)
    fb = read_table(spark, p)
    o = spark.createDataFrame([("1", 1, 5.0, "2024-01-01")],
                              "customer_id string, order_id long, order_value double, order_date string")
    from retentio.operators.label import create_target
    t = create_target(tabular_features(o, as_of="2024-02-01"), fb).first()
    assert t.avg_rating == 1.0 and t.is_at_risk == 1


def _separable(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.2 * x[:, 1] > 0).astype(int)
    data = [(str(i), float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "customer_id string, recency double, monetary double, is_at_risk int")


def test_model_learns_saves_and_reloads(spark, tmpdir_path):
    from retentio.operators.metrics import roc_auc
    df = _separable(spark)
    cols = ["recency", "monetary"]
    opts = ModelOptions(n_estimators=20, max_depth=5)
    m = fit(df, cols, opts)
    scored = predict(m, df, cols)
    assert roc_auc(scored, "is_at_risk", "risk_score").first()[0] > 0.95
    save_model(m, ModelMeta(cols, None), f"{tmpdir_path}/model")
    m2, meta = load_model(spark, f"{tmpdir_path}/model")
    assert meta.feature_columns == cols
    again = predict(m2, df, cols).select("customer_id", F.col("risk_score").alias("s2"))
    assert scored.join(again, "customer_id").where("risk_score <> s2").count() == 0
    m3 = fit(df, cols, opts)
    rerun = predict(m3, df, cols).select("customer_id", F.col("risk_score").alias("s3"))
    assert scored.join(rerun, "customer_id").where("risk_score <> s3").count() == 0
    assert load_model(spark, f"{tmpdir_path}/none") is None


def test_training_job_split_and_cv(spark):
    from retentio.plans.training import train
    df = _separable(spark, 300)
    cols = ["recency", "monetary"]
    model, metrics = train(df, cols, ModelOptions(n_estimators=10, max_depth=4))
    assert metrics["roc_auc"].first()[0] > 0.9
    rep = {r["class"] for r in metrics["classification_report"].collect()}
    assert rep == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    model, metrics = train(df, cols, ModelOptions(n_estimators=10, max_depth=4, cv=True, oversample=True,
                                                  use_class_weight=True))
    assert metrics["cv_pr_auc"].first()[0] > 0.9


def test_single_class_training_fails(spark):
    from retentio.plans.training import train
    df = _separable(spark, 50).withColumn("is_at_risk", F.lit(0))
    with pytest.raises(ValueError):
        train(df, ["recency"], ModelOptions(n_estimators=2))


def test_csv_booleans_and_na_tokens(spark, tmpdir_path):
    p = f"{tmpdir_path}/d.csv"
    with open(p, "w") as fh:
        fh.write("customer_id,on_time,delay_hours,note\n1,True,0,NA\n1,False,N/A,x\n2,,3.5,\n")
    d = read_table(spark, p, fmt="csv")
    types = dict(d.dtypes)
    assert types["on_time"] == "boolean" and types["delay_hours"] == "double" and types["customer_id"] == "string"
    from retentio.operators.features import delivery_metrics
    r = {x.customer_id: x for x in delivery_metrics(d).collect()}
    assert r["1"].on_time_rate == 0.5 and r["1"].avg_delay_hours == 0.0 and r["2"].on_time_rate is None


def test_row_id_follows_file_order(spark, tmpdir_path):
    p = f"{tmpdir_path}/fb.csv"
    with open(p, "w") as fh:
        fh.write("customer_id,feedback_text\n" + "".join(f"1,t{i}\n" for i in range(30)))
    fb = read_table(spark, p, fmt="csv", row_id="feedback_id")
    from retentio.operators.features import feedback_text
    assert feedback_text(fb).first().feedback_text == " ".join(f"t{i}" for i in range(30))
