"""The at-risk classifier on Spark ML: feature selection and alignment
(P2-P4), imputation (M3), standardisation (M4), random forest (M5), class
weights (M6), positive-class probability (M13) and persistence (S2, S3).

A forest's nodes lie in the driver while it is fitted, and in the driver and each
task while it scores.  A forest with more nodes than ``NODES_AT_ONCE`` is therefore
fitted some trees at a time; each part is written to the shared folder and read
again by itself where the forest scores (``ForestParts``).  Fits that run together
take turns with their parts.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.operators.features import KEY
from retentio.operators.label import LABEL
from retentio.operators.quantiles import exact_percentiles
from retentio.operators.text import EMBEDDING

# Name prefixes that make a column a model feature.
FEATURE_PREFIXES = ("recency", "frequency", "monetary", "on_time_rate", "avg_delay_hours", "emb_")

# Spark's random forest rejects depth > 30, so "unlimited" maps to 30.
MAX_SPARK_DEPTH = 30

# Nodes, of all fits that run at a time, that the driver holds by estimate: some 300 bytes each, and
# several times that while they are written or read.
NODES_AT_ONCE = 250_000
#: Held while the driver fits, reads or writes a part of a forest.
_ONE_PART = threading.Lock()


@dataclass
class ModelOptions:
    n_estimators: int = 200
    max_depth: int | None = None    # None: as deep as Spark allows (30)
    max_bins: int = 32
    seed: int = 42
    missing: str = "zero"           # 'zero' (fill with 0 before the pipeline) or 'median'
    scale: bool = True
    use_class_weight: bool = False
    oversample: bool = False
    cv: bool = False
    folds: int = 5
    test_fraction: float = 0.2
    exclude_features: tuple[str, ...] = ()  # e.g. ('recency', 'frequency'), which the label rule reads
    # partitions of the training rows: the forest depends on them, so the number is part of the
    # model (it is kept in the metadata) and never taken from the cluster
    fit_partitions: int = 32
    # execution knobs: statistics that each running task holds in a pass over the rows (more nodes than fit
    # take more passes, and draw their feature subsets in another order) and node-id caching for deep trees
    max_memory_mb: int = 256
    cache_node_ids: bool = True
    parallel_folds: int = 5  # cross-validation folds fitted at a time


@dataclass
class ModelMeta:
    feature_columns: list[str]
    embedder_name: str | None
    embedding_dim: int | None = None
    label: str = LABEL
    options: dict = field(default_factory=dict)
    embedder_state: dict | None = None  # of an encoder that was fitted with the model
    forest_parts: int = 0  # folders that hold the forest; 0: it lies in the pipeline's


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns whose names start with a feature prefix, in frame order (P2), less ``exclude``."""
    return [c for c in df.columns if c.startswith(FEATURE_PREFIXES) and c not in exclude]


def fill_features(df: DataFrame, cols: list[str], dim: int | None = None, scalars: bool = True) -> DataFrame:
    """Missing feature values -> 0 (P4); a missing vector -> zero vector.
    ``scalars=False`` leaves scalar NULLs to a median-imputer stage."""
    exprs = {}
    for c in cols:
        if isinstance(df.schema[c].dataType, T.ArrayType):
            if dim is not None:
                exprs[c] = F.coalesce(F.col(c), F.array_repeat(F.lit(0.0).cast("float"), dim))
        elif scalars:
            exprs[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        else:
            exprs[c] = F.col(c).cast("double")
    return df.withColumns(exprs) if exprs else df


def align_features(df: DataFrame, cols: list[str], dim: int | None = None) -> tuple[DataFrame, list[str]]:
    """Add absent model features as 0.0 (a zero vector for the embedding)
    (P3); returns the frame and the list of added columns."""
    added = [c for c in cols if c not in df.columns]
    exprs = {}
    for c in added:
        if c == EMBEDDING:
            if dim is None:
                raise ValueError("embedding_dim unknown; cannot add a zero embedding")
            exprs[c] = F.array_repeat(F.lit(0.0).cast("float"), dim)
        else:
            exprs[c] = F.lit(0.0)
    return (df.withColumns(exprs) if exprs else df), added


def _assembler_inputs(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Array columns become ML vectors so VectorAssembler can flatten them."""
    out, names = df, []
    for c in cols:
        if isinstance(df.schema[c].dataType, T.ArrayType):
            out = out.withColumn(f"_{c}_vec", array_to_vector(F.col(c)))
            names.append(f"_{c}_vec")
        else:
            names.append(c)
    return out, names


def median_imputer(df: DataFrame, cols: list[str]) -> tuple[SQLTransformer, dict[str, str]]:
    """Fitted exact-median imputer (M3): a SQLTransformer adding
    ``_imp_<c> = coalesce(c, <median>)`` with the medians as literals, so it
    persists inside the PipelineModel and keeps every other column.  All
    medians come from one grouped pass; a column without values is filled with
    0.  Returns the stage and the column -> imputed column mapping."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val"))
                                        for c in cols])))
    # one row for each column that has values
    found = exact_percentiles(long, "_val", [0.5], by=["_col"], names=["m"], narrowing=True).collect()
    meds = dict.fromkeys(cols, 0.0) | {r["_col"]: r["m"] for r in found}
    fills = ", ".join(f"coalesce(`{c}`, {float(m)!r}D) AS `_imp_{c}`" for c, m in meds.items())
    return SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"), {c: f"_imp_{c}" for c in cols}


def standardize(df: DataFrame, cols: list[str], ddof: int = 0) -> DataFrame:
    """z-scores with the population (ddof=0) or sample (ddof=1)
    deviation; a zero deviation divides by 1.  The statistics are one
    aggregate row used as a scalar subquery."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                            *[sd(c).alias(f"s{i}") for i, c in enumerate(cols)]).alias("st")).scalar()
    exprs = {}
    for i, c in enumerate(cols):
        s = stats.getField(f"s{i}")
        exprs[c] = (F.col(c) - stats.getField(f"m{i}")) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return df.withColumns(exprs)


def build_pipeline(df: DataFrame, cols: list[str], opts: ModelOptions, label: str = LABEL,
                   weight_col: str | None = None, dim: int | None = None) -> tuple[Pipeline, DataFrame]:
    """[median imputer] -> [VectorSizeHint] -> VectorAssembler -> [StandardScaler]
    -> RandomForestClassifier.  With ``dim`` the vector size is declared, so
    the assembler needs no look at the data (and the model also works on
    streaming frames)."""
    stages = []
    prepared, inputs = _assembler_inputs(df, cols)
    if dim is not None:
        stages += [VectorSizeHint(inputCol=n, size=dim, handleInvalid="error")
                   for n, c in zip(inputs, cols) if n != c]
    if opts.missing == "median":
        scalar_cols = [c for c in cols if not isinstance(df.schema[c].dataType, T.ArrayType)]
        if scalar_cols:
            stage, mapping = median_imputer(df, scalar_cols)
            stages.append(stage)
            inputs = [mapping.get(c, c) for c in inputs]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="error"))
    feat = "_features"
    if opts.scale:
        stages.append(StandardScaler(inputCol=feat, outputCol="_scaled", withMean=True, withStd=True))
        feat = "_scaled"
    depth = MAX_SPARK_DEPTH if opts.max_depth is None else opts.max_depth
    if depth > MAX_SPARK_DEPTH:
        raise ValueError(f"max_depth is at most {MAX_SPARK_DEPTH}, not {depth}")
    rf = RandomForestClassifier(featuresCol=feat, labelCol=label, numTrees=opts.n_estimators,
                                maxDepth=depth, maxBins=opts.max_bins, seed=opts.seed,
                                probabilityCol="_probability", rawPredictionCol="_raw",
                                predictionCol="_prediction", maxMemoryInMB=opts.max_memory_mb,
                                cacheNodeIds=opts.cache_node_ids)
    if weight_col:
        rf.setWeightCol(weight_col)
    stages.append(rf)
    return Pipeline(stages=stages), prepared


def stable_layout(df: DataFrame, partitions: int, key: str = KEY) -> DataFrame:
    """Hash-partition by key and sort within partitions: the forest's
    bootstrap and bins depend on row placement, so a fixed layout makes a
    fit reproducible."""
    return df.repartition(partitions, key).sortWithinPartitions(key)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    from retentio.session import scratch_dir
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class ForestParts:
    """A fitted pipeline whose forest lies in parts: the stages before it and the folders of forests that
    hold some of its trees each.  One part at a time is loaded."""
    head: PipelineModel
    paths: list[str]

    @property
    def stages(self) -> list:
        return self.head.stages

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` without internal columns, with ``_probability`` and ``_prediction``: the votes of all
        trees, added up part by part.  The rows are written once, and each part's votes."""
        made = self.head.transform(df)
        feat = made.columns[-1]
        rows = _written(made.select(*[c for c in df.columns if not c.startswith("_")],
                                    F.monotonically_increasing_id().alias("_row"), feat), "score-rows")
        votes = None
        for k, path in enumerate(self.paths):
            with _ONE_PART:
                part = RandomForestClassificationModel.load(path)
                cast = part.transform(rows.select("_row", feat))
                cast = _written(cast.select("_row", F.lit(k).alias("_part"), vector_to_array("_raw").alias("_votes")), "votes")
                del part
            votes = cast if votes is None else votes.unionByName(cast)
        # added in the parts' order, so a rerun gives the same sums
        parts = F.array_sort(F.collect_list(F.struct("_part", "_votes")))
        total = F.aggregate(F.transform(F.slice(parts, 2, len(self.paths)), lambda p: p["_votes"]), F.element_at(parts, 1)["_votes"],
                            lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        total = votes.groupBy("_row").agg(total.alias("_votes"))
        of_all = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x)
        return rows.join(total, "_row").drop("_row", feat).select(
            "*", array_to_vector(F.transform("_votes", lambda x: F.when(of_all != 0, x / of_all).otherwise(x))).alias("_probability"),
            (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double").alias("_prediction")).drop("_votes")


def trees_at_once(data: DataFrame, label: str, opts: ModelOptions, beside: int = 1) -> list[int] | None:
    """Number of trees of each part that the forest is fitted in; None where ``beside`` whole forests
    have room in the driver.

    A tree grown to pure leaves has about one node for each row outside the largest class.  The parts
    depend on the rows and options alone, never on the cluster.  One tree would be grown on all
    features, so a part has two at least."""
    depth = MAX_SPARK_DEPTH if opts.max_depth is None else opts.max_depth
    nodes = 2 ** (depth + 1)
    if nodes * opts.n_estimators * beside > NODES_AT_ONCE:
        counts = [r["count"] for r in data.groupBy(label).count().collect()]
        nodes = min(nodes, 1 + (sum(counts) - max(counts, default=0)) * 3 // 2)
    if nodes * opts.n_estimators * beside <= NODES_AT_ONCE:
        return None
    parts = max(1, min(-(-opts.n_estimators // max(1, NODES_AT_ONCE // nodes)), opts.n_estimators // 2))
    return [opts.n_estimators // parts + (k < opts.n_estimators % parts) for k in range(parts)]


def _part_seed(seed: int, part: int) -> int:
    """Spark adds small numbers to a forest's seed, so the parts' seeds lie far apart."""
    return int.from_bytes(hashlib.md5(f"{seed}:{part}".encode()).digest()[:8], "big", signed=True) if part else seed


def _fit_parts(pipe: Pipeline, data: DataFrame, sizes: list[int]) -> ForestParts:
    from retentio.session import scratch_dir
    *before, forest = pipe.getStages()
    head = Pipeline(stages=before).fit(data)
    rows = head.transform(data)
    base, paths = scratch_dir(data.sparkSession, "forest"), []
    for k, n in enumerate(sizes):
        paths.append(f"{base}/part-{k:05d}")
        seed = _part_seed(forest.getSeed(), k)
        with _ONE_PART:
            forest.copy({forest.numTrees: n, forest.seed: seed}).fit(rows).write().save(paths[-1])
            data.sparkSession._jvm.System.gc()  # lets Spark drop the part's broadcasts and shuffle files
    return ForestParts(head, paths)


def fit(df: DataFrame, cols: list[str], opts: ModelOptions, label: str = LABEL, weight_col: str | None = None,
        dim: int | None = None, laid_out: bool = False, beside: int = 1) -> PipelineModel | ForestParts:
    """Fit the pipeline on a reproducible layout.  ``laid_out=True`` means
    ``df`` already is ``stable_layout(...)`` (or a row filter of it), so no
    shuffle is needed here.  ``beside`` fits share the driver's memory."""
    data = fill_features(df, cols, scalars=opts.missing != "median")
    data = data.withColumn(label, F.col(label).cast("double"))
    pipe, prepared = build_pipeline(data, cols, opts, label, weight_col, dim)
    # The fit makes several passes (scaler statistics, split candidates,
    # bagging); keep the prepared rows instead of recomputing the features.
    if not laid_out:
        prepared = stable_layout(prepared, opts.fit_partitions)
    data = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = trees_at_once(data, label, opts, beside)
        return _fit_parts(pipe, data, sizes) if sizes else pipe.fit(data)
    finally:
        data.unpersist()


def predict(model: PipelineModel | ForestParts, df: DataFrame, cols: list[str], dim: int | None = None,
            score_col: str = "risk_score", prediction_col: str | None = None) -> DataFrame:
    """Positive-class probability (M13) as ``score_col``; internal columns dropped.  A forest in parts
    scores at once, part after part; otherwise the result is lazy."""
    imputes = any(isinstance(st, SQLTransformer) for st in model.stages)
    data = fill_features(df, cols, dim, scalars=not imputes)
    prepared, _ = _assembler_inputs(data, cols)
    out = model.transform(prepared)
    out = out.withColumn(score_col, vector_to_array(F.col("_probability"))[1])
    if prediction_col:
        out = out.withColumn(prediction_col, F.col("_prediction").cast("int"))
    internal = [c for c in out.columns if c.startswith("_")]
    return out.drop(*internal)


def save_model(model: PipelineModel | ForestParts, meta: ModelMeta, path: str) -> None:
    """PipelineModel under ``path/pipeline``, a forest in parts under ``path/forest`` and one-row JSON
    metadata under ``path/meta`` (S3)."""
    path = path.rstrip("/")
    parts = model.paths if isinstance(model, ForestParts) else []
    (model.head if parts else model).write().overwrite().save(f"{path}/pipeline")
    for k, part in enumerate(parts):
        with _ONE_PART:
            RandomForestClassificationModel.load(part).write().overwrite().save(_part_folder(path, k))
    spark = SparkSession.getActiveSession()
    payload = json.dumps(asdict(meta) | {"forest_parts": len(parts)})
    spark.createDataFrame([(payload,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _part_folder(path: str, part: int) -> str:
    return f"{path}/forest/part-{part:05d}"


def load_model(spark: SparkSession, path: str, required: bool = False) -> tuple[PipelineModel | ForestParts, ModelMeta] | None:
    """Inverse of ``save_model``; None when the folder does not exist and is not ``required`` (S2).
    An artifact that is there but cannot be read is an error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        if required:
            raise FileNotFoundError(f"no model at {path!r}")
        return None
    path = path.rstrip("/")
    model = PipelineModel.load(f"{path}/pipeline")
    meta = ModelMeta(**json.loads(spark.read.text(f"{path}/meta").first()[0]))
    if meta.forest_parts:
        model = ForestParts(model, [_part_folder(path, k) for k in range(meta.forest_parts)])
    return model, meta
