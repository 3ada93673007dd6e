"""Scoring (D-3): risk score (M13 + P11), band (P10), rating aggregate join
(A5/J4) and suggested intervention (P19)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.columns import clip01, intervention, risk_band
from retentio.operators.features import KEY, rating_metrics
from retentio.operators.model import ForestParts, align_features, predict

SCORE = "risk_score"
BAND = "risk_label"


def with_ratings(scored: DataFrame, feedback: DataFrame | None) -> DataFrame:
    """Attach avg_rating and negative_feedback_count (LEFT join: a customer
    without feedback gets NULLs; without a rating column the count is 0)."""
    ratings = rating_metrics(feedback)
    if ratings is None:
        return scored.withColumns({"avg_rating": F.lit(None).cast("double"),
                                   "negative_feedback_count": F.lit(0).cast("bigint")})
    return scored.join(ratings, KEY, "left")


def band(df: DataFrame, score: str | Column = SCORE) -> DataFrame:
    """Clip the score to [0, 1] and add its band."""
    s = F.col(score) if isinstance(score, str) else score
    return df.withColumn(SCORE, clip01(s)).withColumn(BAND, risk_band(F.col(SCORE)))


def score_customers(features: DataFrame, model: PipelineModel | ForestParts | None = None,
                    feature_columns: list[str] | None = None, embedding_dim: int | None = None,
                    feedback: DataFrame | None = None) -> DataFrame:
    """Scored customers: features + risk_score + risk_label + avg_rating +
    negative_feedback_count.  Without a model every score is 0.0 and the band
    'Unknown'.  A failing model raises (no silent all-Low)."""
    if model is None or feature_columns is None:
        scored = features.withColumns({SCORE: F.lit(0.0), BAND: F.lit("Unknown")})
    else:
        aligned, _ = align_features(features, feature_columns, embedding_dim)
        scored = band(predict(model, aligned, feature_columns, embedding_dim))
    return with_ratings(scored, feedback)


def score_with(features: DataFrame, score: Column, feedback: DataFrame | None = None) -> DataFrame:
    """Scored customers from any score expression (e.g. an external model's
    output column) — same clipping, banding and rating join."""
    return with_ratings(band(features.withColumn(SCORE, score)), feedback)


def with_suggestion(df: DataFrame, out: str = "suggestion") -> DataFrame:
    """Add the suggested intervention; absent inputs use the rule defaults."""
    cols = set(df.columns)
    return df.withColumn(out, intervention(
        BAND if BAND in cols else F.lit(None).cast("string"),
        "avg_rating" if "avg_rating" in cols else None,
        "recency" if "recency" in cols else None,
        "negative_feedback_count" if "negative_feedback_count" in cols else None))
