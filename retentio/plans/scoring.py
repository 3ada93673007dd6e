"""Scoring job: inputs + model artifact -> scored customers (D-3), persisted
once, and the analysis tables over it."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from retentio.operators.features import tabular_features
from retentio.operators.lsa import TextSvd
from retentio.operators.model import load_model
from retentio.operators.risk import score_customers
from retentio.operators.text import feedback_embeddings, join_embeddings


def scored_customers(spark: SparkSession, orders: DataFrame, delivery: DataFrame | None,
                     feedback: DataFrame | None, model_path: str | None = None, model=None,
                     meta=None, as_of=None, vectors: DataFrame | None = None,
                     encoder=None) -> DataFrame:
    """Wide features + embeddings (when the model used text) + scores + ratings.

    The text vectors come from ``vectors`` if given, else from ``encoder``
    (a predict-fn factory, for models trained with one), else from the
    encoder saved or named in the model metadata."""
    if model is None and model_path:
        model, meta = load_model(spark, model_path, required=True)
    feats = tabular_features(orders, delivery, as_of=as_of, wide=True, materialize=True)
    if meta is not None and meta.embedding_dim:
        if encoder is None and meta.embedder_state:
            encoder = TextSvd.from_dict(meta.embedder_state)
        emb = vectors if vectors is not None else feedback_embeddings(
            feedback, encoder if encoder is not None else meta.embedder_name, meta.embedding_dim)
        feats = join_embeddings(feats, emb, meta.embedding_dim)
    return score_customers(feats, model, meta.feature_columns if meta else None,
                           meta.embedding_dim if meta else None, feedback)


def publish_scored(scored: DataFrame, path: str | None = None) -> DataFrame:
    """Write the scored customers once as Parquet (default: a fresh folder
    under the shared checkpoint dir) and return the table read back: every
    analysis view then scans it with pushdown instead of recomputing
    features and scores, and it survives executor loss."""
    from retentio.session import scratch_dir

    spark = scored.sparkSession
    path = path or scratch_dir(spark, "scored")
    scored.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def analysis_tables(scored: DataFrame, orders: DataFrame, labels=None, recency=(0, None),
                    monetary=(None, None), top_n: int = 20) -> dict[str, DataFrame]:
    """The dashboard's datasets over one scored table: filter domains, risk
    distribution, scatter sample, monetary box (+ outliers), correlation
    (all on the filtered customers), top-n with suggestions (all customers)
    and the orders trend (raw orders)."""
    from retentio.operators import views as vw

    filtered = vw.filter_customers(scored, labels, recency, monetary)
    box = vw.monetary_box(filtered)
    out = {
        "filter_domain": vw.filter_domain(scored),
        "risk_distribution": vw.risk_distribution(filtered),
        "scatter_sample": vw.scatter_sample(filtered),
        "monetary_box": box,
        "monetary_outliers": vw.monetary_outliers(filtered, box),
        "correlation": vw.correlation(filtered),
        "top_at_risk": vw.top_at_risk(scored, top_n),
        "top_interventions": vw.top_interventions(scored, top_n),
    }
    trend = vw.orders_trend(orders)
    if trend is not None:
        out["orders_trend"] = trend
    return out


def main(argv=None):
    from retentio.session import get_spark
    from retentio.sources.tables import read_table, write_predictions
    from retentio.operators.text import EMBEDDING, widen

    p = argparse.ArgumentParser(description="Score every customer and export predictions")
    p.add_argument("--orders", required=True)
    p.add_argument("--delivery")
    p.add_argument("--feedback")
    p.add_argument("--model")
    p.add_argument("--out", required=True, help="predictions CSV directory")
    p.add_argument("--tables-out", default=None, help="directory for the analysis tables (Parquet)")
    p.add_argument("--top-n", type=int, default=20)
    p.add_argument("--as-of", default=None)
    p.add_argument("--format", choices=["csv", "parquet"], default=None,
                   help="input format (default: csv for *.csv paths, else parquet)")
    p.add_argument("--no-multiline", action="store_true", help="CSV fields hold no newline: files can be split")
    a = p.parse_args(argv)
    multi = not a.no_multiline
    spark = get_spark()
    orders = read_table(spark, a.orders, fmt=a.format, multiline=multi)
    delivery = read_table(spark, a.delivery, fmt=a.format, optional=True, multiline=multi) if a.delivery else None
    feedback = (read_table(spark, a.feedback, fmt=a.format, optional=True, row_id="feedback_id", multiline=multi)
                if a.feedback else None)
    scored = publish_scored(scored_customers(spark, orders, delivery, feedback, a.model, as_of=a.as_of))
    if a.tables_out:
        for name, table in analysis_tables(scored, orders, top_n=a.top_n).items():
            table.write.mode("overwrite").parquet(f"{a.tables_out.rstrip('/')}/{name}")
    if EMBEDDING in scored.columns:  # export carries emb_0..emb_{d-1} like the feature frame
        loaded = load_model(spark, a.model, required=True) if a.model else None
        scored = widen(scored, loaded[1].embedding_dim) if loaded else scored.drop(EMBEDDING)
    write_predictions(scored, a.out)


if __name__ == "__main__":
    main()
