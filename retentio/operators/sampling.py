"""Class weights (M6), random oversampling (M7), stratified hold-out split
(M8) and stratified folds (M9) — exact counts, reproducible, distributed.

All draws come from md5 of (key, seed): reruns and other engines agree, and
nothing depends on partition layout.  Ranks use ``bucketed_rank`` so no class
is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.operators.features import KEY
from retentio.operators.label import LABEL
from retentio.operators.ranking import HASH_PREFIX_DIGITS, bucketed_rank, hash_int, null_safe_join

SEED = 42


def class_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("class_n"))


def class_weights(df: DataFrame, label: str = LABEL, weight_col: str = "weight") -> DataFrame:
    """Add ``weight`` = n / (k * n_class) ('balanced' weights)."""
    c = class_counts(df, label)
    w = Window.partitionBy()  # over the class-count table: one row per class
    table = c.select(label, (F.sum("class_n").over(w) / (F.count(F.lit(1)).over(w) * F.col("class_n")))
                     .alias(weight_col))
    return null_safe_join(df, table, [label])


def stratified_split(df: DataFrame, label: str = LABEL, key: str = KEY, test_fraction: float = 0.2,
                     seed: int = SEED, split_col: str = "split",
                     prefix_digits: int = HASH_PREFIX_DIGITS) -> DataFrame:
    """Add ``split`` in {'train', 'test'}: per class, the first
    round(test_fraction * n_class) rows in md5(key:seed) order are test."""
    r = bucketed_rank(df, label, key, seed, rank_col="_rk", size_col="class_n", prefix_digits=prefix_digits)
    n_test = F.floor(F.col("class_n") * F.lit(test_fraction) + F.lit(0.5))
    return (r.withColumn(split_col, F.when(F.col("_rk") < n_test, "test").otherwise("train"))
            .drop("_rk", "class_n"))


def stratified_folds(df: DataFrame, label: str = LABEL, key: str = KEY, k: int = 5,
                     seed: int = SEED, fold_col: str = "fold",
                     prefix_digits: int = HASH_PREFIX_DIGITS) -> DataFrame:
    """Add ``fold`` in 0..k-1: per class, rank in md5(key:seed) order mod k."""
    r = bucketed_rank(df, label, key, seed, rank_col="_rk", prefix_digits=prefix_digits)
    return r.withColumn(fold_col, (F.col("_rk") % k).cast("int")).drop("_rk")


#: Draws that one copy of a row is joined to, on average.
DRAWS_PER_COPY = 10_000


def oversample(df: DataFrame, label: str = LABEL, key: str = KEY, seed: int = SEED,
               draw_col: str = "draw", prefix_digits: int = HASH_PREFIX_DIGITS) -> DataFrame:
    """Random oversampling with replacement until every class has as many rows
    as the largest one.  Originals are kept (``draw`` NULL); class c gets
    n_max - n_c extra rows, draw j picking the row of rank
    hash(c, j, seed) mod n_c.

    The j = 0..deficit-1 draws are generated by the largest class's own rows
    of rank < deficit (no driver-side range, no explode in one task); each
    draw is then an equi-join on (label, rank, salt).  A NULL label is a class
    like any other.  A row of a tiny class is drawn very often, so it is copied
    once for every ``DRAWS_PER_COPY`` of its draws to be expected, and draw j
    meets copy j mod copies: no join key holds more, whatever the class sizes.
    """
    ranked = bucketed_rank(df, label, key, seed, rank_col="_rk", prefix_digits=prefix_digits)
    counts = class_counts(df, label)
    w = Window.partitionBy()  # over the class-count table: one row per class
    counts = counts.select(
        label, "class_n",
        F.max("class_n").over(w).alias("_nmax"),
        F.min(F.when(F.col("class_n") == F.max("class_n").over(w), F.col(label))).over(w).alias("_major"),
    )
    needs = counts.where(F.col("class_n") < F.col("_nmax")).select(
        F.col(label).alias("_cls"), F.col("class_n").alias("_ncls"),
        (F.col("_nmax") - F.col("class_n")).alias("_deficit"), F.col("_major"))
    needs = needs.withColumn("_copies", F.ceil(F.col("_deficit") / (F.col("_ncls") * DRAWS_PER_COPY)).cast("bigint"))
    majority = ranked.select(F.col(label).alias("_lab"), F.col("_rk").alias("_j"))
    draws = majority.join(needs, majority._lab.eqNullSafe(needs._major) & (majority._j < needs._deficit), "inner")
    draws = draws.select(
        F.col("_cls").alias(label), F.col("_j").alias(draw_col),
        (hash_int(F.col("_cls"), F.col("_j"), F.lit(seed)) % F.col("_ncls")).alias("_rk"),
        (F.col("_j") % F.col("_copies")).alias("_salt"))
    copies = needs.select(F.col("_cls").alias(label), "_copies")  # a row per class
    copied = null_safe_join(ranked, copies, [label]).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
    extras = null_safe_join(copied, draws, [label, "_rk", "_salt"])
    cols = df.columns
    originals = ranked.select(*cols, F.lit(None).cast("bigint").alias(draw_col))
    return originals.unionByName(extras.select(*cols, F.col(draw_col).cast("bigint")))
