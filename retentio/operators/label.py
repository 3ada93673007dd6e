"""At-risk label (P9, J3, A4), class distribution (A7), guard (A12) and
training diagnostics (M14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators.features import KEY, rating_metrics

LABEL = "is_at_risk"

# Label rule thresholds.
RECENCY_DAYS = 60
MAX_FREQUENCY = 1
MAX_RATING = 2


def at_risk(recency="recency", frequency="frequency", avg_rating="avg_rating"):
    """(recency > 60 and frequency <= 1) or avg_rating <= 2, as int; a NULL
    rating compares false (as NaN does in pandas)."""
    rfm = (F.col(recency) > RECENCY_DAYS) & (F.col(frequency) <= MAX_FREQUENCY)
    rating = F.coalesce(F.col(avg_rating) <= MAX_RATING, F.lit(False))
    return F.when(F.coalesce(rfm, F.lit(False)) | rating, 1).otherwise(0).cast("int")


def create_target(features: DataFrame, feedback: DataFrame | None) -> DataFrame:
    """features + avg_rating (mean rating, NULL when absent) + is_at_risk."""
    ratings = rating_metrics(feedback)
    if ratings is not None:
        df = features.join(ratings.select(KEY, "avg_rating"), KEY, "left")
    else:
        df = features.withColumn("avg_rating", F.lit(None).cast("double"))
    return df.withColumn(LABEL, at_risk())


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """label, count, most frequent first — NULL labels kept (value_counts(dropna=False))."""
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(F.desc("count"), label)


def require_two_classes(df: DataFrame, label: str = LABEL) -> int:
    """Raise when the label has fewer than two classes; returns the class count.

    One small distributed aggregate; Spark ML would otherwise train silently
    on a single class."""
    k = df.agg(F.count_distinct(label)).first()[0]
    if k < 2:
        raise ValueError(f"only {k} class present in {label!r}; training a classifier is not meaningful")
    return k


def training_diagnostics(df: DataFrame, feature_cols: list[str], label: str = LABEL) -> DataFrame:
    """One row: total_samples, n_features, n_positive, n_negative, n_classes."""
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_samples"),
        F.lit(len(feature_cols)).cast("bigint").alias("n_features"),
        F.count_if(F.col(label) == 1).cast("bigint").alias("n_positive"),
        F.count_if(F.col(label) == 0).cast("bigint").alias("n_negative"),
        F.count_distinct(label).cast("bigint").alias("n_classes"),
    )
