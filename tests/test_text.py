"""Feedback vectors: hashed encoder additivity, custom batch encoder, joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.operators import text as txt
from retentio.operators.features import feedback_text
from retentio.operators.model import ModelOptions, fit, predict


def _fb(spark):
    return spark.createDataFrame(
        [("A", 1, "Great service, fast delivery"), ("A", 2, "late again"), ("A", 3, None),
         ("B", 4, "never again"), ("C", 5, None)],
        "customer_id string, feedback_id long, feedback_text string")


def test_hashed_vector_equals_vector_of_joined_text(spark):
    fb = _fb(spark)
    per_row = {r.customer_id: np.array(r.emb_vector) for r in txt.feedback_embeddings(fb).collect()}
    joined = feedback_text(fb).select("customer_id", F.col("feedback_text"), F.lit(0).alias("feedback_id"))
    whole = {r.customer_id: np.array(r.emb_vector) for r in txt.feedback_embeddings(joined).collect()}
    assert set(per_row) == {"A", "B", "C"}
    for k in per_row:
        assert np.allclose(per_row[k], whole[k], atol=1e-6)
    assert np.isclose(np.linalg.norm(per_row["A"]), 1.0, atol=1e-5)
    assert np.allclose(per_row["C"], 0.0)


def _make_encoder():
    def predict_fn(texts):
        return np.stack([np.array([len(t), t.count(" ") + 1, float("again" in t)], dtype=np.float32)
                         for t in texts])
    return predict_fn


def test_custom_batch_encoder(spark):
    out = {r.customer_id: list(r.emb_vector)
           for r in txt.feedback_embeddings(_fb(spark), _make_encoder, dim=3).collect()}
    assert out["B"] == [11.0, 2.0, 1.0]
    assert out["C"] == [0.0, 1.0, 0.0]


def test_join_embeddings_zero_fills_and_widens(spark):
    feats = spark.createDataFrame([("A", 1.0), ("Z", 2.0)], "customer_id string, recency double")
    vecs = spark.createDataFrame([("A", [1.0, 2.0])], "customer_id string, embedding array<float>")
    j = txt.join_embeddings(feats, txt.precomputed_embeddings(vecs), 2)
    w = {r.customer_id: r for r in txt.widen(j, 2).collect()}
    assert w["A"].emb_1 == 2.0 and w["Z"].emb_0 == 0.0
    with pytest.raises(ValueError):
        txt.join_embeddings(feats, txt.precomputed_embeddings(vecs), None)


def test_median_imputer_stage_persists_in_model(spark, tmpdir_path):
    from retentio.operators.model import ModelMeta, load_model, save_model
    rng = np.random.default_rng(1)
    data = []
    for i in range(200):
        x = float(rng.normal())
        data.append((str(i), None if i % 10 == 0 else x, [float(x > 0), 0.5], int(x > 0)))
    df = spark.createDataFrame(data, "customer_id string, recency double, emb_vector array<float>, is_at_risk int")
    cols = ["recency", "emb_vector"]
    m = fit(df, cols, ModelOptions(n_estimators=5, max_depth=3, missing="median"))
    stmt = m.stages[0].getStatement()
    assert "coalesce(`recency`" in stmt
    s1 = predict(m, df, cols, dim=2)
    save_model(m, ModelMeta(cols, None, 2), f"{tmpdir_path}/m")
    m2, _ = load_model(spark, f"{tmpdir_path}/m")
    s2 = predict(m2, df, cols, dim=2).select("customer_id", F.col("risk_score").alias("s2"))
    assert s1.join(s2, "customer_id").where("risk_score <> s2").count() == 0


def test_training_and_scoring_with_a_custom_encoder(spark):
    from retentio.plans.scoring import scored_customers
    from retentio.plans.training import run
    o = spark.createDataFrame([(str(i), i, 10.0 + i, "2024-01-01") for i in range(40)],
                              "customer_id string, order_id long, order_value double, order_date string")
    fb = spark.createDataFrame([(str(i), i, "bad again" if i % 2 else "great", float(1 + 3 * (i % 2 == 0)))
                                for i in range(40)],
                               "customer_id string, feedback_id long, feedback_text string, rating double")
    model, meta, _ = run(spark, o, None, fb, None, ModelOptions(n_estimators=5, max_depth=3),
                         as_of="2024-02-01", encoder=_make_encoder, dim=3)
    assert meta.embedder_name == "_make_encoder" and meta.embedding_dim == 3
    scored = scored_customers(spark, o, None, fb, model=model, meta=meta, as_of="2024-02-01",
                              encoder=_make_encoder)
    assert scored.count() == 40 and scored.where("risk_label = 'Unknown'").count() == 0


def test_tokens_keep_non_ascii_letters(spark):
    from pyspark.ml.feature import RegexTokenizer
    df = spark.createDataFrame([("Café naïve Привет 東京",)], "t string")
    tok = RegexTokenizer(inputCol="t", outputCol="w", pattern="(?U)\\W+", gaps=True, toLowercase=True)
    assert tok.transform(df).first().w == ["café", "naïve", "привет", "東京"]
    fb = spark.createDataFrame([("A", 1, "Café"), ("B", 2, "Caf")],
                               "customer_id string, feedback_id long, feedback_text string")
    v = {r.customer_id: list(r.emb_vector) for r in txt.feedback_embeddings(fb, "hashing-1024").collect()}
    assert v["A"] != v["B"]
