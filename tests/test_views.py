"""Dashboard datasets: trend granularity/column choice, filters, top-n, box."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retentio.operators import views as vw


def _orders(spark, days):
    base = dt.datetime(2020, 1, 1)
    data = [(i, (base + dt.timedelta(days=d)).strftime("%Y-%m-%d")) for i, d in enumerate(days)]
    return spark.createDataFrame(data, "order_id long, order_date string")


def test_trend_granularity_540_is_daily_541_monthly(spark):
    assert vw.choose_trend_column(_orders(spark, [0, 540]))[1] == "day"
    assert vw.choose_trend_column(_orders(spark, [0, 541]))[1] == "month"
    t = vw.orders_trend(_orders(spark, [0, 1, 1, 541]))
    got = sorted((r.order_period.month, r.num_orders) for r in t.collect())
    assert got == [(1, 3), (6, 1)]


def test_trend_column_choice_skips_unparsable(spark):
    df = spark.createDataFrame([("bad", "2020-01-05", 1), ("worse", "2020-01-06", 2)],
                               "order_date string, date string, order_id long")
    assert vw.choose_trend_column(df) == ("date", "day")
    assert vw.orders_trend(df).count() == 2
    assert vw.orders_trend(df.drop("date")) is None


def _scored(spark):
    data = [("1", 0.9, "High", 10, 1, 100.0), ("2", 0.5, "Medium", -1, 2, 50.0),
            ("3", 0.1, "Low", 400, 1, None), ("4", 0.9, "High", 5, 3, 10.0)]
    return spark.createDataFrame(data, "customer_id string, risk_score double, risk_label string, "
                                       "recency long, frequency long, monetary double")


def test_default_filter_excludes_negative_recency_and_null_money(spark):
    ids = sorted(r.customer_id for r in vw.filter_customers(_scored(spark)).collect())
    assert ids == ["1", "4"]
    ids = sorted(r.customer_id for r in vw.filter_customers(_scored(spark), labels=["High"],
                                                            monetary=(20, None)).collect())
    assert ids == ["1"]


def test_top_n_orders_ties_by_id_for_any_n(spark):
    top = [r.customer_id for r in vw.top_at_risk(_scored(spark), 5).collect()]
    assert top == ["1", "4", "2", "3"]
    assert [r.customer_id for r in vw.top_at_risk(_scored(spark), 1).collect()] == ["1"]
    assert len(vw.top_interventions(_scored(spark), 1000).collect()) == 4


def test_box_statistics(spark):
    df = spark.createDataFrame([(str(i), "High", float(v)) for i, v in enumerate([1, 2, 3, 10])]
                               + [("9", "Low", 5.0)], "customer_id string, risk_label string, monetary double")
    b = {r.risk_label: r for r in vw.monetary_box(df).collect()}
    assert b["High"].median == 2.5 and b["High"].q1 == 1.75 and b["High"].q3 == 4.75
    assert b["Low"].n == 1 and b["Low"].q1 == 5.0
    out = vw.monetary_outliers(df, vw.monetary_box(df)).collect()
    assert [r.monetary for r in out] == [10.0]


def test_customer_detail_and_feedback(spark):
    d = vw.customer_detail(_scored(spark), 2)
    fields = {r.field: r.value for r in d.collect()}
    assert fields["risk_label"] == "Medium" and fields["risk_score"] == "0.500000"
    assert vw.customer_detail(_scored(spark), "nope").count() == 0
    fb = spark.createDataFrame([(i, "2", f"t{i}", 3.0) for i in range(60)],
                               "feedback_id long, customer_id string, feedback_text string, rating double")
    rows = vw.customer_feedback(fb, 2).collect()
    assert len(rows) == 60 and rows[0].feedback_text == "t0"
    assert len(vw.customer_feedback(fb, 2, n=50).collect()) == 50


def test_scatter_sample_is_bounded_and_reproducible(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("customer_id"),
                                  F.lit(1).alias("recency"), F.lit(1).alias("frequency"),
                                  F.lit(1.0).alias("monetary"), F.lit("Low").alias("risk_label"))
    a = [r.customer_id for r in vw.scatter_sample(df).collect()]
    b = [r.customer_id for r in vw.scatter_sample(df).collect()]
    assert len(a) == 2000 and a == b


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 0.0, None if i == 3 else float(-i)) for i in range(6)],
                               "recency double, frequency double, risk_score double, monetary double")
    c = {(r.feature_x, r.feature_y): r.corr for r in vw.correlation(df).collect()}
    assert c[("recency", "frequency")] == 1.0 and c[("frequency", "recency")] == 1.0
    assert c[("recency", "risk_score")] is None and c[("risk_score", "risk_score")] is None
    assert c[("recency", "monetary")] == -1.0


def test_customer_detail_prints_numbers_of_any_size(spark):
    df = spark.createDataFrame([("1", 1e33, 0.5, "Low", 1.0, 2.0), ("2", 1.25, 0.5, "Low", 1.0, 2.0)],
                               "customer_id string, monetary double, risk_score double, risk_label string, recency double, avg_rating double")
    value = lambda k: dict(map(tuple, vw.customer_detail(df, k).collect()))["monetary"]
    assert float(value("1")) == 1e33 and value("2") == "1.250000"
