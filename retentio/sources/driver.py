"""Views that present the driver's TPC-H-style test tables as the three
retention inputs (orders, delivery, feedback) plus precomputed embeddings.

All views are lazy projections/joins over ``spark.read.parquet``, so column
pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, order_id, order_value, order_date (timestamp)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("order_value"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
    )


def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: customer_id, on_time (bool), delay_hours (double),
    plus order_id and line_number (the row key, used by previews).

    Line items are joined to their order on the order key (a shuffle join on
    both sides at scale; no broadcast of a growing table).
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    ship = F.col("l_shipdate").cast("date")
    ordered = F.col("o_orderdate").cast("date")
    return j.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        (F.col("l_shipdate") <= F.col("o_orderdate")).alias("on_time"),
        (F.greatest(F.datediff(ship, ordered), F.lit(0)) * 24).cast("double").alias("delay_hours"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, feedback_id, feedback_text, rating (double, may be NULL).

    Two documents per customer (doc_id div 2); the rating is derived from the
    optional quality/toxicity labels through a correlated scalar subquery:
    a query that does not use ``rating`` (the text encoder) does not touch
    the labels at all, and one that does gets a join against labels
    aggregated per doc_id (so duplicate labels could never multiply rows).
    """
    d = table(spark, sf_dir, "documents").alias("d")
    lab = table(spark, sf_dir, "labels")
    rating = (F.when(F.col("toxic") == 1, F.lit(1))
              .when(F.col("quality") == 0, F.lit(2))
              .when(F.col("quality") == 1, F.lit(3) + F.col("doc_id") % 3)).cast("double")
    rating_of_doc = lab.where(F.col("doc_id") == F.col("d.doc_id").outer()).select(F.max(rating)).scalar()
    return d.select(
        F.expr("d.doc_id div 2").cast("string").alias("customer_id"),
        F.col("d.doc_id").alias("feedback_id"),
        F.col("d.text").alias("feedback_text"),
        rating_of_doc.alias("rating"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, embedding array<float> (precomputed vectors)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("customer_id"), F.col("embedding"))


def pseudo_score(customer_id="customer_id"):
    """Deterministic stand-in score in [0, 1] for oracle-checked risk views:
    (key * 37 mod 101) / 100, which hits the band edges 0.40 and 0.70."""
    c = F.col(customer_id) if isinstance(customer_id, str) else customer_id
    return ((c.cast("bigint") * 37) % 101).cast("double") / 100.0
