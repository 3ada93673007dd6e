"""Edge fixtures for the per-customer aggregates (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from retentio.operators import features as feat

AS_OF = "2024-02-01 00:00:00"
ORD = "customer_id string, order_id long, order_value double, order_date string"


def rows(df, key="customer_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_null_customer_is_dropped(spark):
    o = spark.createDataFrame([(None, 3, 7.0, "2024-01-01"), ("A", 1, 5.0, "2024-01-01")], ORD)
    out = rows(feat.orders_aggregate(o, as_of=AS_OF))
    assert set(out) == {"A"}


def test_bad_date_lenient_and_strict(spark):
    o = spark.createDataFrame([("B", 1, 5.0, "bad"), ("A", 2, 5.0, "2024-01-01")], ORD)
    f = rows(feat.tabular_features(o, as_of=AS_OF))
    assert f["B"]["recency"] == 999
    assert f["A"]["recency"] == 31
    with pytest.raises(Exception):
        feat.orders_aggregate(o, as_of=AS_OF, strict_dates=True).collect()


def test_null_order_id_not_counted(spark):
    o = spark.createDataFrame([("B", None, 5.0, "2024-01-01")], ORD)
    assert rows(feat.tabular_features(o, as_of=AS_OF))["B"]["frequency"] == 0


def test_missing_values_take_median_over_customers(spark):
    o = spark.createDataFrame([("A", 1, 1.0, "2024-01-01"), ("A", 2, None, "2024-01-01"),
                               ("B", 3, None, "2024-01-01")], ORD)
    f = rows(feat.tabular_features(o, as_of=AS_OF))
    assert f["A"]["monetary"] == 1.0 and f["B"]["monetary"] == 1.0


def test_even_median_is_interpolated(spark):
    data = [(c, i, v, "2024-01-01") for i, (c, v) in enumerate([("A", 1.0), ("B", 2.0), ("C", 3.0),
                                                                ("D", 10.0), ("E", None)])]
    f = rows(feat.tabular_features(spark.createDataFrame(data, ORD), as_of=AS_OF))
    assert f["E"]["monetary"] == 2.5


def test_future_order_floors_days(spark):
    o = spark.createDataFrame([("A", 1, 1.0, "2024-02-02 01:00:00")], ORD)
    assert rows(feat.tabular_features(o, as_of=AS_OF))["A"]["recency"] == -2


def test_delivery_without_on_time_counts_null_delay_as_late(spark):
    d = spark.createDataFrame([("A", 0.0), ("A", None)], "customer_id string, delay_hours double")
    r = rows(feat.delivery_metrics(d))["A"]
    assert r["on_time_rate"] == 0.5 and r["avg_delay_hours"] == 0.0


def test_delivery_with_on_time_only(spark):
    d = spark.createDataFrame([("A", True), ("A", False)], "customer_id string, on_time boolean")
    r = rows(feat.delivery_metrics(d))["A"]
    assert r["on_time_rate"] == 0.5 and r["avg_delay_hours"] == 0.0


def test_feedback_text_skips_nulls_and_keeps_order(spark):
    fb = spark.createDataFrame([("A", 2, "y"), ("A", 1, "x"), ("A", 3, None), ("B", 4, None)],
                               "customer_id string, feedback_id long, feedback_text string")
    out = rows(feat.feedback_text(fb))
    assert out["A"]["feedback_text"] == "x y" and out["B"]["feedback_text"] == ""


def test_text_column_alias(spark):
    fb = spark.createDataFrame([("A", 1, "hi")], "customer_id string, feedback_id long, text string")
    assert rows(feat.feedback_text(fb))["A"]["feedback_text"] == "hi"
    assert feat.feedback_text(fb.drop("text")) is None


def test_null_rating_is_not_negative(spark):
    fb = spark.createDataFrame([("A", 1.0), ("A", None)], "customer_id string, rating double")
    r = rows(feat.rating_metrics(fb))["A"]
    assert r["avg_rating"] == 1.0 and r["negative_feedback_count"] == 1


def test_nan_rating_read_as_null(spark, tmpdir_path):
    from retentio.sources.tables import read_table
    p = f"{tmpdir_path}/fb.parquet"
    spark.createDataFrame([("A", float("nan")), ("A", 4.0)], "customer_id string, rating double") \
        .write.parquet(p)
    fb = read_table(spark, p)
    assert rows(feat.rating_metrics(fb))["A"]["avg_rating"] == 4.0


def test_unkeyed_orders_become_numbered_customers(spark):
    o = spark.createDataFrame([(i, float(i)) for i in range(600)], "order_id long, order_value double")
    u = feat.unkeyed_orders(o)
    assert u.count() == 600 and feat.unkeyed_orders(o, n=500).count() == 500
    r = u.where(F.col("customer_id") == "1").first()
    assert r["order_id"] == 0 and r["num_orders_90d"] == 1 and r["days_since_last_order"] == 30


def test_missing_order_value_uses_count(spark):
    o = spark.createDataFrame([("A", 1, "2024-01-01"), ("A", 2, "2024-01-02")],
                              "customer_id string, order_id long, order_date string")
    with pytest.warns(UserWarning):
        agg = feat.orders_aggregate(o, as_of=AS_OF)
    assert rows(agg)["A"]["avg_order_value"] == 2.0


def test_joins_keep_one_row_per_customer(spark):
    o = spark.createDataFrame([("A", 1, 1.0, "2024-01-01"), ("B", 2, 2.0, "2024-01-01")], ORD)
    d = spark.createDataFrame([("A", True), ("A", False), ("C", True)], "customer_id string, on_time boolean")
    f = feat.tabular_features(o, d, as_of=AS_OF)
    assert f.count() == 2
    assert rows(f)["B"]["on_time_rate"] is None


def test_tabular_features_on_unkeyed_orders(spark):
    o = spark.createDataFrame([(i, float(i) if i % 7 else None) for i in range(20)],
                              "order_id long, order_value double")
    d = spark.createDataFrame([("1", True), ("2", False)], "customer_id string, on_time boolean")
    f = rows(feat.tabular_features(o, d, as_of=AS_OF, wide=True))
    assert len(f) == 20 and f["1"]["recency"] == 30 and f["1"]["frequency"] == 1
    assert f["1"]["on_time_rate"] == 1.0 and f["3"]["on_time_rate"] is None
    # order 0 has no value: monetary falls back to the median over customers
    import numpy as np
    assert f["1"]["monetary"] == float(np.median([float(i) for i in range(20) if i % 7]))
