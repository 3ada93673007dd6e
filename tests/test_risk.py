"""Label, band and intervention rules at their boundaries."""

from pyspark.sql import functions as F

from retentio.functions import columns as C
from retentio.operators.label import at_risk
from retentio.operators.risk import score_with, with_suggestion


def test_label_boundaries(spark):
    data = [(60, 1, None), (61, 1, None), (61, 2, None), (0, 5, 2.0), (0, 5, 2.01), (0, 5, None)]
    df = spark.createDataFrame(data, "recency long, frequency long, avg_rating double")
    got = [r[0] for r in df.select(at_risk()).collect()]
    assert got == [0, 1, 0, 1, 0, 0]


def test_band_boundaries(spark):
    df = spark.createDataFrame([(0.3999,), (0.4,), (0.6999,), (0.7,), (1.5,), (-1.0,)], "s double")
    got = [r[0] for r in df.select(C.risk_band(C.clip01("s"))).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High", "Low"]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,)], "s double")
    assert df.select(C.clip01("s")).first()[0] is None


def test_intervention_order_and_nulls(spark):
    data = [("High", 2.0, 91, 0), ("High", None, 90, None), ("High", 4.0, 95, 1), ("High", 4.0, 10, 1),
            ("Medium", 3.0, 0, 0), ("Medium", None, 0, 0), ("Low", 1.0, 500, 9), ("Unknown", 1.0, 1, 1)]
    df = spark.createDataFrame(data, "risk_label string, avg_rating double, recency long, "
                                     "negative_feedback_count long")
    got = [r["suggestion"] for r in with_suggestion(df).collect()]
    assert got == [C.SUGGEST_PERSONAL_OUTREACH, C.SUGGEST_LOYALTY, C.SUGGEST_WIN_BACK, C.SUGGEST_ESCALATE,
                   C.SUGGEST_SURVEY, C.SUGGEST_NUDGE, C.SUGGEST_MONITOR, C.SUGGEST_MONITOR]


def test_intervention_defaults_for_absent_columns(spark):
    df = spark.createDataFrame([("High",)], "risk_label string")
    assert with_suggestion(df).first()["suggestion"] == C.SUGGEST_WIN_BACK


def test_score_with_and_ratings(spark):
    feats = spark.createDataFrame([("1", 5), ("2", 7)], "customer_id string, recency long")
    fb = spark.createDataFrame([("1", 1.0), ("1", None)], "customer_id string, rating double")
    out = {r["customer_id"]: r for r in score_with(feats, F.lit(0.75), fb).collect()}
    assert out["1"]["risk_label"] == "High" and out["1"]["negative_feedback_count"] == 1
    assert out["2"]["avg_rating"] is None and out["2"]["negative_feedback_count"] is None


def test_feature_columns_by_prefix(spark):
    from retentio.operators.model import feature_columns
    df = spark.createDataFrame([("1", 1, 1, 1.0, 0.5, 2.0, 4.0, 3.0, 0, [1.0])],
                               "customer_id string, recency long, frequency long, monetary double, "
                               "on_time_rate double, avg_delay_hours double, rating double, avg_rating double, "
                               "is_at_risk int, emb_vector array<float>")
    assert feature_columns(df) == ["recency", "frequency", "monetary", "on_time_rate", "avg_delay_hours",
                                   "emb_vector"]


def test_alignment_adds_zero_columns(spark):
    from retentio.operators.model import align_features
    df = spark.createDataFrame([("1", 3.0)], "customer_id string, recency double")
    out, added = align_features(df, ["recency", "monetary", "emb_vector"], dim=2)
    r = out.first()
    assert added == ["monetary", "emb_vector"] and r.monetary == 0.0 and list(r.emb_vector) == [0.0, 0.0]
