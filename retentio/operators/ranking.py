"""Exact running totals and ranks without a single-task window.

A plain ``row_number().over(Window.partitionBy(label).orderBy(x))`` sends a
whole class to one task, and an unpartitioned window sends everything to one
task.  Instead each row gets an *order-preserving bucket*; per-bucket totals
form a small table (``#groups x #buckets`` rows) whose running sum is the
offset of every bucket, and the exact running total is that offset plus a
window running sum inside ``(group, bucket)`` — thousands of small window
partitions spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: hex digits of the md5 prefix used as the hash bucket (16^3 = 4096).
HASH_PREFIX_DIGITS = 3


def hash_order(key, seed) -> Column:
    """md5(key || ':' || seed) — a reproducible pseudo-random order key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


def hash_int(*parts) -> Column:
    """Non-negative integer from the first 15 hex digits (60 bits) of md5(parts joined by ':')."""
    s = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the right side's keys are dropped."""
    named = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(named)
    on = [left[k].eqNullSafe(right[r]) for k, r in named.items()]
    return left.join(right, on, how).drop(*named.values())


def running_totals(df: DataFrame, order_by: Sequence[str], sums: Sequence[str],
                   by: Sequence[str] = (), bucket: str = "_b", suffix: str = "_cum",
                   with_totals: bool = False) -> DataFrame:
    """Add ``<c><suffix>`` = inclusive running sum of ``c`` in ``order_by``
    order within ``by`` groups, for each ``c`` in ``sums`` (and, with
    ``with_totals``, ``<c>_total`` = the group's whole sum).

    ``bucket`` must be non-decreasing in ``order_by`` within a group, and
    ``order_by`` must be unique within a group.  The bucket-total table is
    joined back on (by, bucket); it is small, so AQE turns the join into a
    broadcast at run time, and it falls back to a shuffle join otherwise.
    """
    by = list(by)
    totals = df.groupBy(*by, bucket).agg(*[F.sum(c).alias(f"_bt_{c}") for c in sums])
    # over the bucket-total table only (#groups x #buckets rows)
    w_off = Window.partitionBy(*by).orderBy(bucket) if by else Window.orderBy(bucket)
    w_all = Window.partitionBy(*by)
    offsets = totals.select(*by, bucket, *[
        (F.sum(f"_bt_{c}").over(w_off) - F.col(f"_bt_{c}")).alias(f"_off_{c}") for c in sums],
        *([F.sum(f"_bt_{c}").over(w_all).alias(f"{c}_total") for c in sums] if with_totals else []))
    w_in = (Window.partitionBy(*by, bucket).orderBy(*order_by)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = null_safe_join(df, offsets, [*by, bucket])
    out = out.withColumns({f"{c}{suffix}": F.col(f"_off_{c}") + F.sum(c).over(w_in) for c in sums})
    return out.drop(*[f"_off_{c}" for c in sums])


def bucketed_rank(df: DataFrame, by: Sequence[str] | str, key: str, seed: int = 42,
                  rank_col: str = "rank", prefix_digits: int = HASH_PREFIX_DIGITS,
                  size_col: str | None = None) -> DataFrame:
    """0-based rank of each row inside its ``by`` group in md5(key:seed) order
    (ties on the hash broken by ``key``); ``size_col`` adds the group size.

    Equals ``row_number() over (partition by <by> order by md5(key||':'||seed), key) - 1``.
    """
    by = [by] if isinstance(by, str) else list(by)
    h = hash_order(key, seed)
    d = df.withColumns({"_h": h, "_b": F.substring(h, 1, prefix_digits), "_one": F.lit(1).cast("bigint")})
    r = running_totals(d, ["_h", key], ["_one"], by=by, bucket="_b", with_totals=size_col is not None)
    r = r.withColumn(rank_col, F.col("_one_cum") - 1)
    if size_col is not None:
        r = r.withColumnRenamed("_one_total", size_col)
    return r.drop("_h", "_b", "_one", "_one_cum")


def quantile_bucket(df: DataFrame, value: str, buckets: int = 1024, out: str = "_b",
                    accuracy: int = 10000) -> DataFrame:
    """Add an order-preserving bucket of ``value`` (0..buckets-1) whose
    boundaries are approximate quantiles, so buckets hold similar row counts.

    The boundaries are one bounded array (``buckets - 1`` doubles) attached as
    a scalar subquery; the bucket is a branch-free binary search over it, all
    JVM-side.
    """
    probs = [i / buckets for i in range(1, buckets)]
    splits = (df.agg(F.percentile_approx(F.col(value).cast("double"), probs, accuracy).alias("s"))
              .select(F.array_sort(F.array_distinct(F.col("s"))).alias("s")).scalar())
    steps = max(1, (buckets - 1).bit_length())
    v = F.col(value).cast("double")
    s = F.col("_splits")

    def step(pos, i):
        nxt = pos + F.pow(F.lit(2), F.lit(steps) - i).cast("int")
        return F.when(F.try_element_at(s, nxt) <= v, nxt).otherwise(pos)

    pos = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), step)
    return df.withColumn("_splits", splits).withColumn(out, pos).drop("_splits")


def range_bucket(df: DataFrame, order_by: Sequence[str], buckets: int = 1024, out: str = "_b", tie: str = "_tie",
                 sample_per_bucket: int = 16) -> DataFrame:
    """Add an order-preserving bucket (0..buckets-1) of the columns ``order_by``, of any sortable types,
    and the column ``tie``, a hash of the row that orders rows equal in them.

    Splitters are every ``sample_per_bucket``-th of a sorted sample of about ``buckets *
    sample_per_bucket`` rows, drawn by hash at the rate that the row count gives, so buckets hold
    similar numbers of rows whatever the keys look like.  As the sample is of (keys, hash), one key
    with very many rows is split over buckets, too; only rows equal in every column stay together.
    The sample is all that is gathered; splitters are one array in a scalar subquery, searched in
    steps on the JVM.
    """
    order_by = list(order_by)
    hashable = [c for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
    df = df.withColumn(tie, F.xxhash64(*hashable))
    wanted = float(buckets * sample_per_bucket)
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    # the hash of the hash, as rows drawn by the tie itself would all have low ties
    drawn = F.pmod(F.xxhash64(F.col(tie), F.lit(1)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * wanted / n
    sample = df.where(drawn).agg(F.sort_array(F.collect_set(F.struct(*order_by, tie))).alias("s"))
    stride = F.greatest(F.size("s") / buckets, F.lit(1.0))
    picked = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get(F.col("s"), F.floor(i * stride).cast("int")))
    splits = sample.select(F.array_sort(F.array_distinct(F.filter(picked, lambda x: x.isNotNull()))).alias("s")).scalar()
    return place_among(df, splits, F.struct(*order_by, tie), buckets - 1, out)


def place_among(df: DataFrame, splits: Column, value: Column, most: int, out: str) -> DataFrame:
    """Add ``out``: how many of the sorted array ``splits`` (of at most ``most`` elements) do not exceed
    ``value``.  One projection halves the search each time, all in generated code; the array is referred
    to, not carried along in the rows."""
    df = df.withColumn(out, F.lit(0))
    for i in reversed(range(most.bit_length())):
        at = F.col(out)
        df = df.withColumn(out, at + F.when(F.get(splits, at + ((1 << i) - 1)) <= value, 1 << i).otherwise(0))
    return df
