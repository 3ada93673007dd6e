"""Exact percentiles of huge groups by narrowing histograms (A6, A10, M3).

Every wanted rank starts with the whole range of its group.  A round sketches
the values inside each range, cuts it at the sketch's quantiles - each cut
value is a bin of its own, so are the values between two cuts - and counts the
bins; a rank's new range is the smallest and largest value of the bin that it
falls into.  A range holds about 1/``BINS`` of the one before, or a single
value however often that occurs, so a few rounds lead from any number of rows
to ranges of at most ``exact_rows`` rows, whose values are then ranked.

Sketches and bin counts merge, so what is shuffled in a round is a few
thousand numbers for each task, group and rank, and in the end at most
``exact_rows`` values for each group and rank: never the column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.operators.ranking import null_safe_join, place_among
from retentio.session import checkpoint_base, scratch_dir

BINS = 512
#: Ranges of this many rows are ranked directly.
EXACT_ROWS = 1 << 16
#: Ranges are broadcast up to this many (some 50 bytes each), joined by group beyond.
BROADCAST_RANGES = 50_000


def _with_ranges(values: DataFrame, ranges: DataFrame, by: Sequence[str], count: int) -> DataFrame:
    """Each value with the ranges of its group that hold it."""
    if not by:
        held = values.crossJoin(F.broadcast(ranges))  # two rows a percentile
    else:
        held = null_safe_join(values, F.broadcast(ranges) if count <= BROADCAST_RANGES else ranges, by)
    return held.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def narrowed_percentiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], names: Sequence[str],
                         exact_rows: int = EXACT_ROWS, bins: int = BINS) -> DataFrame:
    """One row per ``by`` group with one column per probability, interpolated linearly.

    NULL values are ignored; NaN is the largest value; a group without values
    gets no row, and a global call without values one row of NULLs.  The values
    are written once to the scratch folder and read in each round.
    """
    spark, by = df.sparkSession, list(by)
    checkpoint_base(spark)
    path = scratch_dir(spark, "values")
    df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()).write.parquet(path)
    values = spark.read.parquet(path)
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    ranks = sizes.where("_n > 0").select(*by, "_n", "_lo", "_hi", wanted.alias("w")).withColumn("_at", F.col("w.p") * (F.col("_n") - 1))
    low = F.floor("_at")
    ranks = ranks.select(*by, "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_inside"),
                         F.col("w.i").alias("_i"), (F.col("_at") - low).alias("_part"),
                         F.explode(F.array(F.struct(F.lit(0).alias("up"), low.alias("rank")), F.struct(
                             F.lit(1).alias("up"), F.least(low + 1, F.col("_n") - 1).alias("rank")))).alias("_r"))
    ranks = ranks.select("*", "_r.up", "_r.rank").drop("_r").checkpoint()
    where = ["_lo", "_hi", "_below", "_inside"]
    while True:
        wide = F.col("_lo") < F.col("_hi")
        ranges = ranks.where(wide & (F.col("_inside") > exact_rows)).select(*by, *where).distinct().checkpoint()
        count = ranges.count()
        if not count:
            break
        held = _with_ranges(values, ranges, by, count)
        sketch = held.groupBy(*by, *where).agg(F.percentile_approx("_v", [i / bins for i in range(1, bins)], 4 * bins).alias("s"))
        cut = sketch.select(*by, *where, F.array_sort(F.array_distinct("s")).alias("_s")).checkpoint()
        held = place_among(_with_ranges(values, cut, by, count), F.col("_s"), F.col("_v"), bins - 1, "_place")
        # 2 * i for the i-th cut value, 2 * i + 1 for values between it and the next, 1 below the first
        at_cut = F.coalesce(F.get("_s", F.col("_place") - 1) == F.col("_v"), F.lit(False))
        counted = (held.withColumn("_bin", 2 * F.col("_place") + F.when(at_cut, 0).otherwise(1))
                   .groupBy(*by, *where, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")))
        # at most 2 * bins rows a range
        order = Window.partitionBy(*by, *where).orderBy("_bin")
        counted = counted.withColumn("_start", F.col("_below") + F.sum("_c").over(order) - F.col("_c"))
        told = null_safe_join(ranks.where(wide & (F.col("_inside") > exact_rows)), counted, [*by, *where])
        told = told.where((F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("_c")))
        told = told.select(*by, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_start").alias("_below"),
                           F.col("_c").alias("_inside"), "_i", "_part", "up", "rank")
        ranks = ranks.where(~(wide & (F.col("_inside") > exact_rows))).unionByName(told).checkpoint()
    ranges = ranks.where("_lo < _hi").select(*by, *where).distinct().checkpoint()
    near = (_with_ranges(values, ranges, by, ranges.count()).groupBy(*by, *where, "_v").agg(F.count(F.lit(1)).alias("_c")))
    # at most `exact_rows` rows a range
    order = Window.partitionBy(*by, *where).orderBy("_v")
    near = near.withColumn("_start", F.col("_below") + F.sum("_c").over(order) - F.col("_c"))
    found = null_safe_join(ranks.where("_lo < _hi"), near, [*by, *where]).where(
        (F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("_c")))
    every = (found.select(*by, "_i", "_part", "up", "_v")
             .unionByName(ranks.where(~(F.col("_lo") < F.col("_hi"))).select(*by, "_i", "_part", "up", F.col("_lo").alias("_v"))))
    aggs = []
    for i in range(len(probs)):
        here = F.col("_i") == i
        aggs += [F.max(F.when(here & (F.col("up") == up), F.col("_v"))).alias(f"_v{up}_{i}") for up in (0, 1)]
        aggs.append(F.max(F.when(here, F.col("_part"))).alias(f"_f{i}"))
    picked = every.groupBy(*by).agg(*aggs)
    return picked.select(*by, *[(F.col(f"_v0_{i}") + F.col(f"_f{i}") * (F.col(f"_v1_{i}") - F.col(f"_v0_{i}"))).alias(n)
                                for i, n in enumerate(names)])
