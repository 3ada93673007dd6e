"""The analysis tables a retention team reads (D-4 .. D-12), each a lazy
query over the scored-customers table, so a filter change or a customer
lookup never recomputes features or scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.functions.columns import timestamp_col, whole_days_between
from retentio.functions.resolve import resolve_columns
from retentio.operators.features import KEY
from retentio.operators.quantiles import exact_percentiles
from retentio.operators.ranking import hash_order
from retentio.operators.risk import BAND, SCORE, with_suggestion

# Fixed values (dashboard defaults and limits).
SCATTER_POINTS = 2000
TOP_N_DEFAULT = 20
TREND_DATE_COLUMNS = ("order_date", "date", "created_at", "order_timestamp")
MONTHLY_AFTER_DAYS = 540
TOP_COLUMNS = ("customer_id", "risk_score", "risk_label", "recency", "frequency", "monetary")
FEEDBACK_COLUMNS = ("feedback_text", "rating", "created_at")
CORRELATION_COLUMNS = ("recency", "frequency", "monetary", "on_time_rate", "avg_delay_hours", "risk_score")


def filter_customers(scored: DataFrame, labels: Sequence[str] | None = None,
                     recency: tuple[float | None, float | None] = (0, None),
                     monetary: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Label in set AND recency in [lo, hi] AND monetary in [lo, hi] (P12).

    A None bound is open; rows with NULL recency/monetary never pass (the
    default recency range starts at 0, so a future last order is excluded).
    """
    cond = F.col("recency").isNotNull() & F.col("monetary").isNotNull()
    if labels is not None:
        cond &= F.col(BAND).isin(list(labels))
    for name, (lo, hi) in (("recency", recency), ("monetary", monetary)):
        if lo is not None:
            cond &= F.col(name) >= lo
        if hi is not None:
            cond &= F.col(name) <= hi
    return scored.where(cond)


def filter_domain(scored: DataFrame) -> DataFrame:
    """One row: labels (sorted, comma-joined), min/max recency, min/max
    monetary, number of customers (A8); ``filter_ids`` has the customers."""
    return scored.agg(
        F.array_join(F.sort_array(F.collect_set(BAND)), ",").alias("labels"),
        F.min("recency").alias("min_recency"), F.max("recency").alias("max_recency"),
        F.min("monetary").alias("min_monetary"), F.max("monetary").alias("max_monetary"),
        F.count(F.lit(1)).cast("bigint").alias("n_customers"))


def filter_ids(scored: DataFrame) -> DataFrame:
    """The customers to choose from, each once (A8): a table, as it grows with the customers."""
    return scored.select(KEY).where(F.col(KEY).isNotNull()).distinct()


def risk_distribution(filtered: DataFrame) -> DataFrame:
    """risk_label, count, most frequent first (D-4)."""
    return filtered.groupBy(BAND).agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(F.desc("count"), BAND)


def scatter_sample(filtered: DataFrame, n: int = SCATTER_POINTS, seed: int = 42) -> DataFrame:
    """Reproducible sample of up to ``n`` customers without replacement (D-5):
    the n smallest md5(customer_id:seed) — a top-k, no full sort."""
    return (filtered.select(KEY, "recency", "frequency", "monetary", BAND,
                            hash_order(KEY, seed).alias("_h"))
            .orderBy("_h").limit(n).drop("_h"))


def choose_trend_column(orders: DataFrame) -> tuple[str | None, str | None]:
    """(date column, 'month' | 'day') or (None, None) (A9, D-6).

    The first candidate with at least one parsable value wins; monthly when
    its floored day span exceeds 540.  One distributed aggregate decides it.
    """
    cands = [c for c in TREND_DATE_COLUMNS if c in orders.columns]
    if not cands:
        return None, None
    aggs = []
    for i, c in enumerate(cands):
        t = timestamp_col(orders, c)
        aggs += [F.count(t).alias(f"n{i}"), F.min(t).alias(f"lo{i}"), F.max(t).alias(f"hi{i}")]
    row = orders.agg(*aggs).select(
        *[F.col(f"n{i}") for i in range(len(cands))],
        *[whole_days_between(F.col(f"hi{i}"), F.col(f"lo{i}")).alias(f"span{i}") for i in range(len(cands))]
    ).first()
    for i, c in enumerate(cands):
        if row[f"n{i}"] > 0:
            return c, ("month" if row[f"span{i}"] > MONTHLY_AFTER_DAYS else "day")
    return None, None


def orders_trend(orders: DataFrame, granularity: str = "auto") -> DataFrame | None:
    """order_period (timestamp), num_orders — counts ``order_id`` when present,
    else the date; rows with an unparsable date are dropped.  Absent periods
    are not filled in.  None when no date column parses.  ``granularity`` is
    'day', 'month' or 'auto' (monthly when the dates span more than 540 days)."""
    if granularity not in ("auto", "day", "month"):
        raise ValueError("granularity must be 'auto', 'day' or 'month'")
    col, unit = choose_trend_column(orders)
    unit = unit if granularity == "auto" else granularity
    if col is None:
        return None
    t = orders.withColumn("_d", timestamp_col(orders, col)).where(F.col("_d").isNotNull())
    counted = F.count("order_id") if "order_id" in orders.columns else F.count("_d")
    return (t.groupBy(F.date_trunc(unit, F.col("_d")).alias("order_period"))
            .agg(counted.cast("bigint").alias("num_orders")))


def monetary_box(filtered: DataFrame, value: str = "monetary", relative_error: float | None = None) -> DataFrame:
    """Per risk label: n, min, q1, median, q3, max, lower/upper 1.5*IQR fences (D-7)."""
    q = exact_percentiles(filtered, value, [0.25, 0.5, 0.75], by=[BAND], names=["q1", "median", "q3"],
                          relative_error=relative_error, narrowing=True)
    mm = (filtered.where(F.col(value).isNotNull()).groupBy(BAND)
          .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")))
    iqr = F.col("q3") - F.col("q1")
    return mm.join(q, BAND, "inner").select(
        BAND, "n", "min", "q1", "median", "q3", "max",
        (F.col("q1") - 1.5 * iqr).alias("lower_fence"), (F.col("q3") + 1.5 * iqr).alias("upper_fence"))


def monetary_outliers(filtered: DataFrame, box: DataFrame, value: str = "monetary") -> DataFrame:
    """Customers outside their label's fences (the individual box-plot points)."""
    return (filtered.join(box.select(BAND, "lower_fence", "upper_fence"), BAND, "inner")
            .where((F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence")))
            .select(KEY, BAND, value))


def correlation(filtered: DataFrame, cols: Sequence[str] = CORRELATION_COLUMNS, digits: int = 6) -> DataFrame:
    """feature_x, feature_y, corr — Pearson for every pair (incl. the
    diagonal), NULL pairs skipped, all pairs in one aggregate (D-8)."""
    cols = resolve_columns(filtered, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]

    def pearson(a: str, b: str):
        # pairwise-complete rows; a constant column gives NULL instead of a
        # division-by-zero error (ANSI), as pandas gives NaN
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    row = filtered.agg(*[pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    structs = []
    for i, (a, b) in enumerate(pairs):
        structs.append(F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"),
                                F.round(F.col(f"c{i}"), digits).alias("corr")))
        if a != b:
            structs.append(F.struct(F.lit(b).alias("feature_x"), F.lit(a).alias("feature_y"),
                                    F.round(F.col(f"c{i}"), digits).alias("corr")))
    return row.select(F.inline(F.array(*structs)))


def top_at_risk(scored: DataFrame, n: int = TOP_N_DEFAULT) -> DataFrame:
    """Top ``n`` customers by score over all customers, ties by id (L1)."""
    return scored.orderBy(F.col(SCORE).desc(), F.col(KEY)).limit(n).select(*resolve_columns(scored, TOP_COLUMNS))


def top_interventions(scored: DataFrame, n: int = TOP_N_DEFAULT) -> DataFrame:
    """Top ``n`` with the suggested intervention (L2)."""
    top = scored.orderBy(F.col(SCORE).desc(), F.col(KEY)).limit(n)
    return with_suggestion(top).select(KEY, BAND, SCORE, "suggestion")


def customer_detail(scored: DataFrame, customer_id, digits: int = 6) -> DataFrame:
    """The chosen customer as (field, value) string pairs, suggestion last (P15).
    Empty when the id is unknown.  Numbers are printed as fixed decimals."""
    row = with_suggestion(scored.where(F.col(KEY) == F.lit(str(customer_id))))
    fields = []
    for f in row.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            # a number of more digits is printed as it is
            v = F.coalesce(F.round(c, digits).try_cast(f"decimal(38,{digits})").cast("string"), c.cast("string"))
        elif f.dataType.typeName() == "array":
            v = F.to_json(c)
        else:
            v = c.cast("string")
        fields.append(F.struct(F.lit(f.name).alias("field"), v.alias("value")))
    return row.select(F.inline(F.array(*fields)))


def customer_feedback(feedback: DataFrame, customer_id, n: int | None = None,
                      order_by: str = "feedback_id") -> DataFrame:
    """The customer's feedback rows, the first ``n`` if given: feedback_text, rating,
    created_at where present (all columns when none is) (P16)."""
    fb = feedback.where(F.col(KEY).cast("string") == F.lit(str(customer_id)))
    cols = resolve_columns(fb, FEEDBACK_COLUMNS)
    keys = [order_by] if order_by in fb.columns else [cols[0] if cols else fb.columns[0]]
    top = fb.orderBy(*keys)
    top = top if n is None else top.limit(n)
    return top.select(*(([order_by] if order_by in fb.columns else []) + cols)) if cols else top
