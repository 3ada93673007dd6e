"""Per-customer features: orders RFM (A1), delivery metrics (A2), feedback
text (A3), rating metrics (A4/A5) and the combined tabular features (D-1).

Every aggregate is a plain ``groupBy(customer_id).agg(...)``: Spark runs a
map-side partial aggregate, so a customer holding a third of all rows is
reduced inside each map task before the shuffle, and only one small row per
(customer, map task) crosses the network.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.columns import exact_mean, timestamp_col, whole_days_between
from retentio.functions.resolve import with_text_column
from retentio.operators.ranking import range_bucket, running_totals

KEY = "customer_id"

# Defaults taken when a value is missing.
RECENCY_MISSING = 999
FREQUENCY_MISSING = 0
UNKEYED_DAYS_SINCE = 30
UNKEYED_VALUE = 100.0


def as_of_column(as_of) -> Column:
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def orders_aggregate(orders: DataFrame, as_of=None, strict_dates: bool = False, order_key: str | None = None,
                     frequency_window_days: int | None = None) -> DataFrame:
    """customer_id, num_orders_90d, avg_order_value, days_since_last_order.

    ``num_orders_90d`` keeps its historical name but counts all history
    (decision D1) unless ``frequency_window_days`` limits it to orders of so many
    days before ``as_of`` (default: now).  Without ``order_id`` the parsed dates are counted; without
    ``order_value`` the order count stands in for money (with a warning).
    Orders without ``customer_id`` take the unkeyed path (P8).
    """
    cols = set(orders.columns)
    if KEY not in cols:
        return unkeyed_orders(orders, order_key=order_key)
    if "order_date" not in cols:
        raise ValueError("orders need an 'order_date' column")
    if "order_id" not in cols and "order_value" not in cols:
        raise ValueError("orders need 'order_id' or 'order_value'")
    o = orders.where(F.col(KEY).isNotNull())
    o = o.withColumn("order_date", timestamp_col(o, "order_date", strict=strict_dates))
    counted = F.col("order_id") if "order_id" in cols else F.col("order_date")
    if frequency_window_days is not None:
        since = as_of_column(as_of) - F.make_dt_interval(F.lit(frequency_window_days))
        counted = F.when(F.col("order_date") > since, counted)
    n_orders = F.count(counted)
    if "order_value" in cols:
        value = exact_mean("order_value")
    else:
        warnings.warn("orders have no 'order_value': the order count is used as monetary value")
        value = F.count("order_id").cast("double")
    last = F.max("order_date")
    return o.groupBy(KEY).agg(
        n_orders.cast("bigint").alias("num_orders_90d"),
        value.alias("avg_order_value"),
        whole_days_between(as_of_column(as_of), last).alias("days_since_last_order"),
    )


def unkeyed_orders(orders: DataFrame, order_key: str | None = None,
                   n: int | None = None) -> DataFrame:
    """Orders without a customer key: each row, in ``order_key`` order, becomes
    a customer '1', '2', ... with one order, 30 days since the last order and
    its own order value (100 when there is none); ``n`` keeps the first n rows
    only.  The other columns are kept.  The key may be of any sortable type; equal
    ones are numbered in the order of a hash of the row.  Numbers are bucket offsets
    plus ranks inside buckets of similar size, so no task numbers the whole table."""
    key = order_key or ("order_id" if "order_id" in orders.columns else orders.columns[0])
    head = orders if n is None else orders.orderBy(key).limit(n)
    head = range_bucket(head.withColumn("_one", F.lit(1).cast("bigint")), [key])
    others = [c for c in orders.columns if c != key and orders.schema[c].dataType.typeName() not in ("map", "variant")]
    numbered = running_totals(head, [key, "_tie", *others], ["_one"], bucket="_b").drop("_one", "_b", "_tie")
    value = (F.col("order_value").cast("double") if "order_value" in orders.columns
             else F.lit(UNKEYED_VALUE))
    return numbered.select(
        *orders.columns, F.col("_one_cum").cast("string").alias(KEY),
        F.lit(1).cast("bigint").alias("num_orders_90d"),
        value.alias("avg_order_value"),
        F.lit(UNKEYED_DAYS_SINCE).cast("bigint").alias("days_since_last_order"),
    )


def delivery_metrics(delivery: DataFrame) -> DataFrame:
    """customer_id, on_time_rate, avg_delay_hours (A2).

    Without ``on_time`` the rate is the share of rows with zero delay (a NULL
    delay counts as late); without ``delay_hours`` the delay is 0.
    """
    cols = set(delivery.columns)
    if "on_time" not in cols and "delay_hours" not in cols:
        raise ValueError("delivery needs 'on_time' or 'delay_hours'")
    if "on_time" in cols:
        rate = exact_mean(F.col("on_time").cast("int"))
    else:
        rate = exact_mean(F.when(F.col("delay_hours") == 0, 1).otherwise(0))
    delay = exact_mean("delay_hours") if "delay_hours" in cols else F.lit(0.0)
    return (delivery.where(F.col(KEY).isNotNull())
            .groupBy(KEY).agg(rate.alias("on_time_rate"), delay.cast("double").alias("avg_delay_hours")))


def rating_metrics(feedback: DataFrame | None) -> DataFrame | None:
    """customer_id, avg_rating, negative_feedback_count (A4, A5); None when the
    feedback has no key or no rating.  A NULL rating is not negative."""
    if feedback is None or KEY not in feedback.columns or "rating" not in feedback.columns:
        return None
    r = F.col("rating")
    return (feedback.where(F.col(KEY).isNotNull())
            .groupBy(KEY).agg(exact_mean(r).alias("avg_rating"),
                              F.count_if(r <= 2).cast("bigint").alias("negative_feedback_count")))


def feedback_text(feedback: DataFrame | None, order_by: str = "feedback_id") -> DataFrame | None:
    """customer_id, feedback_text: a customer's non-null texts joined by one
    space in ``order_by`` order ('' when all are NULL) (A3).

    The default text encoder does not need this string (term counts add up
    over the parts); it exists for encoders that must see the whole text.
    """
    if feedback is None or KEY not in feedback.columns:
        return None
    fb = with_text_column(feedback)
    if fb is None:
        return None
    if order_by not in fb.columns:
        raise ValueError(f"feedback needs an order column ({order_by!r}) to join texts deterministically")
    joined = F.expr(f"listagg(feedback_text, ' ') within group (order by {order_by})")
    return (fb.where(F.col(KEY).isNotNull())
            .groupBy(KEY).agg(F.coalesce(joined, F.lit("")).alias("feedback_text")))


def median_of(df: DataFrame, col: str, relative_error: float | None = None) -> Column:
    """Scalar-subquery column holding the median of ``col`` over all rows."""
    from retentio.operators.quantiles import exact_percentiles

    med = exact_percentiles(df, col, [0.5], names=["median"], relative_error=relative_error)
    return med.select("median").scalar()


def tabular_features(orders: DataFrame, delivery: DataFrame | None = None, as_of=None,
                     wide: bool = False, strict_dates: bool = False,
                     median_relative_error: float | None = None, materialize: bool = False,
                     frequency_window_days: int | None = None) -> DataFrame:
    """Training features (D-1): customer_id, recency, frequency, monetary,
    on_time_rate, avg_delay_hours.  ``wide=True`` keeps num_orders_90d,
    avg_order_value and days_since_last_order as well (the scoring frame).

    Missing recency -> 999, frequency -> 0, monetary -> median over customers
    (exact unless ``median_relative_error`` is given).

    The default is one lazy plan.  With ``materialize``, as the jobs do, the
    per-customer table (orders aggregate joined with delivery metrics) is
    written once as Parquet to the shared folder: the median (a fitted
    statistic) and the features then read that table, pruned and filtered,
    instead of re-scanning and re-shuffling the inputs, and the median is
    skipped when no customer lacks a value.
    """
    agg = orders_aggregate(orders, as_of=as_of, strict_dates=strict_dates, frequency_window_days=frequency_window_days)
    if delivery is not None and KEY in delivery.columns:
        df = agg.join(delivery_metrics(delivery), KEY, "left")
    else:
        df = agg.withColumns({"on_time_rate": F.lit(None).cast("double"),
                              "avg_delay_hours": F.lit(None).cast("double")})
    need_median = True
    if materialize:
        from retentio.session import scratch_dir
        path = scratch_dir(df.sparkSession, "customers")
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
        need_median = df.where(F.col("avg_order_value").isNull()).limit(1).count() > 0
    # one row per customer either way (the delivery side is unique per key)
    med = median_of(df, "avg_order_value", median_relative_error) if need_median else F.lit(None).cast("double")
    df = df.withColumns({
        "recency": F.coalesce(F.col("days_since_last_order"), F.lit(RECENCY_MISSING).cast("bigint")),
        "frequency": F.coalesce(F.col("num_orders_90d"), F.lit(FREQUENCY_MISSING).cast("bigint")),
        "monetary": F.coalesce(F.col("avg_order_value"), med),
    })
    base = [KEY, "recency", "frequency", "monetary", "on_time_rate", "avg_delay_hours"]
    if wide:
        extra = [c for c in df.columns if c not in base]
        return df.select(*base, *extra)
    return df.select(*base)
