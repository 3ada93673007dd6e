"""Training job (M15): features -> embeddings -> label -> guard -> [oversample]
-> split or cross-validation -> fit -> metrics -> artifact."""

from __future__ import annotations

import argparse
import functools
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import asdict

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.operators.features import KEY, tabular_features
from retentio.operators.label import LABEL, create_target, require_two_classes, training_diagnostics
from retentio.operators.lsa import TextSvd, svd_dim
from retentio.operators.metrics import classification_report, pr_auc, roc_auc
from retentio.operators.model import (
    ForestParts, ModelMeta, ModelOptions, feature_columns, fill_features, fit, predict, save_model, stable_layout,
)
from retentio.operators.sampling import class_weights, oversample, stratified_folds, stratified_split
from retentio.operators.text import DEFAULT_DIM, DEFAULT_ENCODER, feedback_embeddings, hashing_dim, join_embeddings


def training_frame(orders: DataFrame, delivery: DataFrame | None, feedback: DataFrame | None,
                   as_of=None, encoder=DEFAULT_ENCODER, dim: int | None = DEFAULT_DIM,
                   vectors: DataFrame | None = None, exclude: Sequence[str] = (),
                   frequency_window_days: int | None = None) -> tuple[DataFrame, list[str], int | None]:
    """Labelled training set (D-2), its feature columns and the embedding dim.

    ``vectors`` (customer_id, emb_vector) overrides the encoder."""
    feats = tabular_features(orders, delivery, as_of=as_of, materialize=True, frequency_window_days=frequency_window_days)
    if vectors is None and isinstance(encoder, TextSvd):
        dim = encoder.dim
    elif vectors is None and isinstance(encoder, str):
        dim = hashing_dim(encoder) or dim  # the encoder's name says how long its vectors are
    emb = vectors if vectors is not None else feedback_embeddings(feedback, encoder, dim)
    if emb is not None:
        feats = join_embeddings(feats, emb, dim)
    df = create_target(feats, feedback)
    cols = feature_columns(df, exclude)
    return df, cols, (dim if emb is not None else None)


def _weights(df: DataFrame, opts: ModelOptions) -> tuple[DataFrame, str | None]:
    if opts.use_class_weight:
        return class_weights(df, LABEL, "_weight"), "_weight"
    return df, None


def _scores(model: PipelineModel | ForestParts, df: DataFrame, cols: list[str], dim: int | None) -> DataFrame:
    return predict(model, df, cols, dim, score_col="score", prediction_col="prediction")


def run_together(spark: SparkSession, tasks: Sequence[Callable], width: int) -> list:
    """Results of the tasks, up to ``width`` of them at a time.  Each submits its Spark jobs from an own
    thread and in an own scheduler pool, so under fair scheduling one task's last, narrow stages leave their
    cores to the others.  The first failure cancels the jobs of the rest and is raised."""
    tag = f"together-{uuid.uuid4().hex[:12]}"

    def call(k, task):
        spark.sparkContext.addJobTag(tag)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{tag}-{k}")
        return task()

    with ThreadPoolExecutor(max(1, width)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(call), k, t) for k, t in enumerate(tasks)]
        done, rest = wait(running, return_when=FIRST_EXCEPTION)
        failed = next((f.exception() for f in running if f in done and f.exception()), None)
        while failed is not None and rest:
            for f in rest:
                f.cancel()
            spark.sparkContext.cancelJobsWithTag(tag)
            rest = wait(rest, timeout=1.0).not_done  # a fit submits its next job until it is told
        if failed is not None:
            raise failed
        return [f.result() for f in running]


def train(df: DataFrame, cols: list[str], opts: ModelOptions, dim: int | None = None
          ) -> tuple[PipelineModel | ForestParts, dict[str, DataFrame]]:
    """Fit the classifier; returns the model and a dict of metric tables.

    Without ``cv``: stratified hold-out split, fit on the training part,
    classification report and ROC AUC on the test part.  With ``cv``:
    stratified k-fold out-of-fold scores -> PR AUC, and a final fit on all rows;
    folds are fitted ``parallel_folds`` at a time from one checkpointed layout, with
    the final fit beside them.  Oversampling touches only the data a model is fit on (never the
    rows it is evaluated on)."""
    from retentio.session import checkpoint_base
    checkpoint_base(df.sparkSession)
    df = fill_features(df, cols, dim, scalars=opts.missing != "median").select(KEY, LABEL, *cols)
    # Assign folds / the hold-out split once and checkpoint the labelled rows:
    # the guard, every fit and every evaluation then read this table instead
    # of recomputing features, embeddings and ranks.
    if opts.cv:
        df = stratified_folds(df, LABEL, KEY, opts.folds, opts.seed)
    else:
        df = stratified_split(df, LABEL, KEY, opts.test_fraction, opts.seed)
    # Lay the rows out once (hash by key, sorted) before the checkpoint: every
    # fit then reads a ready layout and needs no shuffle of its own, unless
    # oversampling or weights add rows/columns through a join.
    df = stable_layout(df, opts.fit_partitions).checkpoint(eager=True)
    laid_out = not (opts.oversample or opts.use_class_weight)
    require_two_classes(df, LABEL)
    metrics: dict[str, DataFrame] = {"diagnostics": training_diagnostics(df, cols)}

    def prepare(part: DataFrame) -> tuple[DataFrame, str | None]:
        if opts.oversample:
            part = oversample(part.select(KEY, LABEL, *cols), LABEL, KEY, opts.seed).drop("draw")
        return _weights(part, opts)

    if opts.cv:
        beside = opts.folds + 1  # whatever runs at a time, so that the forests do not depend on it

        def fold(k: int) -> DataFrame:
            tr, w = prepare(df.where(F.col("fold") != k).drop("fold"))
            m = fit(tr, cols, opts, LABEL, w, dim, laid_out, beside)
            # written by itself: a task loads the models of all folds in its plan
            return (_scores(m, df.where(F.col("fold") == k), cols, dim)
                    .select(KEY, LABEL, "score", "prediction").checkpoint(eager=True))

        def final() -> PipelineModel | ForestParts:
            full, w = prepare(df.drop("fold"))
            return fit(full, cols, opts, LABEL, w, dim, laid_out, beside)

        model, *parts = run_together(
            df.sparkSession, [final, *(functools.partial(fold, k) for k in range(opts.folds))], opts.parallel_folds + 1)
        oof = parts[0]
        for p in parts[1:]:
            oof = oof.unionByName(p)
        metrics["cv_scores"] = oof
        metrics["cv_pr_auc"] = pr_auc(oof, LABEL, "score")
        return model, metrics

    tr, w = prepare(df.where(F.col("split") == "train").drop("split"))
    model = fit(tr, cols, opts, LABEL, w, dim, laid_out)
    test = (_scores(model, df.where(F.col("split") == "test").drop("split"), cols, dim)
            .select(KEY, LABEL, "score", "prediction").checkpoint(eager=True))
    metrics["test_scores"] = test
    metrics["classification_report"] = classification_report(test, LABEL, "prediction")
    metrics["roc_auc"] = roc_auc(test, LABEL, "score")
    return model, metrics


def run(spark: SparkSession, orders: DataFrame, delivery: DataFrame | None, feedback: DataFrame | None,
        model_path: str | None, opts: ModelOptions, as_of=None, encoder=DEFAULT_ENCODER,
        dim: int | None = DEFAULT_DIM, vectors: DataFrame | None = None):
    if vectors is None and isinstance(encoder, str) and svd_dim(encoder):
        encoder = TextSvd.fit(feedback, svd_dim(encoder)) if feedback is not None else None
    df, cols, d = training_frame(orders, delivery, feedback, as_of, encoder, dim, vectors, opts.exclude_features)
    model, metrics = train(df, cols, opts, d)
    fitted = isinstance(encoder, TextSvd)
    name = encoder if isinstance(encoder, str) else encoder.name if fitted else getattr(encoder, "__name__", repr(encoder))
    used = vectors is None and bool(d)
    meta = ModelMeta(feature_columns=cols, embedder_name=(name if used else None), embedding_dim=d, options=asdict(opts),
                     embedder_state=(encoder.to_dict() if used and fitted else None))
    if model_path:
        save_model(model, meta, model_path)
    return model, meta, metrics


def main(argv=None):
    from retentio.session import get_spark
    from retentio.sources.tables import read_table

    p = argparse.ArgumentParser(description="Train the at-risk classifier")
    p.add_argument("--orders", required=True)
    p.add_argument("--delivery")
    p.add_argument("--feedback")
    p.add_argument("--model", required=True, help="output directory for the model artifact")
    p.add_argument("--as-of", default=None)
    p.add_argument("--format", choices=["csv", "parquet"], default=None,
                   help="input format (default: csv for *.csv paths, else parquet)")
    p.add_argument("--encoder", default=DEFAULT_ENCODER,
                   help="text encoder: hashing-<dim> (stateless) or svd-<dim> (fitted on the feedback)")
    p.add_argument("--n_estimators", type=int, default=200)
    p.add_argument("--max_depth", type=lambda s: None if s.lower() == "none" else int(s), default=None,
                   help="'none' (default): as deep as Spark allows, 30")
    p.add_argument("--fit-partitions", type=int, default=ModelOptions.fit_partitions)
    p.add_argument("--exclude", nargs="*", default=[], help="feature columns to leave out")
    p.add_argument("--no-multiline", action="store_true", help="CSV fields hold no newline: files can be split")
    p.add_argument("--oversample", action="store_true")
    p.add_argument("--use_class_weight", action="store_true")
    p.add_argument("--cv", action="store_true")
    a = p.parse_args(argv)
    spark = get_spark()
    multi = not a.no_multiline
    orders = read_table(spark, a.orders, fmt=a.format, multiline=multi)
    delivery = read_table(spark, a.delivery, fmt=a.format, optional=True, multiline=multi) if a.delivery else None
    feedback = (read_table(spark, a.feedback, fmt=a.format, optional=True, row_id="feedback_id", multiline=multi)
                if a.feedback else None)
    opts = ModelOptions(n_estimators=a.n_estimators, max_depth=a.max_depth, oversample=a.oversample,
                        use_class_weight=a.use_class_weight, cv=a.cv, fit_partitions=a.fit_partitions,
                        exclude_features=tuple(a.exclude))
    _, _, metrics = run(spark, orders, delivery, feedback, a.model, opts, as_of=a.as_of, encoder=a.encoder)
    for name, m in metrics.items():
        print(f"--- {name}")
        m.show(truncate=False)


if __name__ == "__main__":
    main()
