"""Native column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed reference point of the queries and tests over the driver tables: the day
# after the last order date at every scale.  The operators' own default is now.
AS_OF_DEFAULT = "2001-08-02 00:00:00"

# Lenient date parsing tries these patterns in order, per row (decision D3).
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
)

MICROS_PER_DAY = 86_400_000_000


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Turn floating NaN into SQL NULL (pandas skips NaN; Spark would not)."""
    float_types = (T.DoubleType, T.FloatType)
    targets = [f.name for f in df.schema.fields
               if isinstance(f.dataType, float_types) and (cols is None or f.name in cols)]
    if not targets:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in targets})


def normalize_key(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Cast the entity key to string once, at load, before any groupBy/join."""
    if key not in df.columns:
        return df
    if isinstance(df.schema[key].dataType, T.StringType):
        return df
    return df.withColumn(key, F.col(key).cast("string"))


def parse_date(c, formats: Iterable[str] = DATE_FORMATS, strict: bool = False) -> Column:
    """Parse a date/time column to ``timestamp``.

    Already-typed timestamps/dates are cast (``timestamp_ntz`` is read as UTC).
    Strings: lenient mode tries each format and yields NULL when none fits;
    strict mode raises on a bad value (ANSI ``to_timestamp``).
    """
    col = as_column(c)
    if strict:
        return F.to_timestamp(col)
    attempts = [F.try_to_timestamp(col.cast("string"))]
    attempts += [F.try_to_timestamp(col.cast("string"), F.lit(fmt)) for fmt in formats]
    return F.coalesce(*attempts)


def timestamp_col(df: DataFrame, name: str, strict: bool = False) -> Column:
    """``name`` as a ``timestamp``: cast when typed, parsed when text."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    return parse_date(F.col(name), strict=strict)


def whole_days_between(later, earlier) -> Column:
    """Floored whole days of ``later - earlier`` (pandas ``Timedelta.days``)."""
    diff = F.unix_micros(as_column(later)) - F.unix_micros(as_column(earlier))
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("bigint")


# Decimal places that exact_mean sums exactly, and the size up to which it does.
MEAN_SCALE_DIGITS = 6
MEAN_EXACT_BELOW = 1e15


def exact_mean(c) -> Column:
    """Mean of a column, not rounded; NULL and NaN are skipped, NULL without values.

    Each value is split into a ``decimal(38,6)`` part, whose sum is exact and
    cannot overflow with trillions of rows, and the double that is left over
    (the whole value from 1e15 on), which is summed apart.  Values of at most
    six decimals - money, ratings, flags - leave nothing over, so their mean
    does not depend on row order or partition layout.
    """
    col = as_column(c).cast("double")
    v = F.when(~F.isnan(col), col)
    part = F.when(F.abs(v) < MEAN_EXACT_BELOW, v.try_cast(f"decimal(38,{MEAN_SCALE_DIGITS})"))
    left = v - F.coalesce(part.cast("double"), F.lit(0.0))
    total = F.coalesce(F.sum(part).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(left), F.lit(0.0))
    return F.try_divide(total, F.count(v))


def unparsable_dates(df: DataFrame, name: str) -> DataFrame:
    """One row: n_values (not null) and n_unparsable, the values of a date column that lenient
    parsing turns into NULL."""
    t = timestamp_col(df, name)
    return df.agg(F.count(F.col(name)).alias("n_values"),
                  F.count_if(F.col(name).isNotNull() & t.isNull()).cast("bigint").alias("n_unparsable"))


def clip01(c) -> Column:
    """Clip to [0, 1]; NULL stays NULL (greatest/least alone would make it 1.0)."""
    col = as_column(c)
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col)))


# Risk band thresholds (inclusive lower bounds).
HIGH_THRESHOLD = 0.7
MEDIUM_THRESHOLD = 0.4


def risk_band(score) -> Column:
    """High (>= 0.7), Medium (>= 0.4), Low otherwise (a NULL score is Low, as a
    NaN is in pandas).  'Unknown' is assigned by the caller when there is no model."""
    s = as_column(score)
    return (F.when(s >= HIGH_THRESHOLD, F.lit("High"))
            .when(s >= MEDIUM_THRESHOLD, F.lit("Medium"))
            .otherwise(F.lit("Low")))


# The suggested interventions, verbatim, in rule order.
SUGGEST_PERSONAL_OUTREACH = "Personal outreach: call from CS + refund/priority support"
SUGGEST_WIN_BACK = "Win-back: targeted discount + reminder email"
SUGGEST_ESCALATE = "Escalate to retention team + offer credit"
SUGGEST_LOYALTY = "Loyalty offer + curated recommendations"
SUGGEST_SURVEY = "Automated survey + coupon for next order"
SUGGEST_NUDGE = "Email nudge with recommendations"
SUGGEST_MONITOR = "Monitor"


def intervention(label="risk_label", avg_rating="avg_rating", recency="recency",
                 negative_count="negative_feedback_count") -> Column:
    """Suggested intervention, first matching rule wins.

    A NULL comparison falls through, exactly like NaN comparisons in pandas.
    Pass ``None`` for a column the frame does not have: recency then defaults
    to 999 and the negative count to 0.
    """
    lab = as_column(label)
    rating = as_column(avg_rating) if avg_rating is not None else F.lit(None).cast("double")
    rec = as_column(recency) if recency is not None else F.lit(999)
    neg = as_column(negative_count) if negative_count is not None else F.lit(0)
    return (F.when((lab == "High") & (rating <= 2), F.lit(SUGGEST_PERSONAL_OUTREACH))
            .when((lab == "High") & (rec > 90), F.lit(SUGGEST_WIN_BACK))
            .when((lab == "High") & (neg > 0), F.lit(SUGGEST_ESCALATE))
            .when(lab == "High", F.lit(SUGGEST_LOYALTY))
            .when((lab == "Medium") & (rating <= 3), F.lit(SUGGEST_SURVEY))
            .when(lab == "Medium", F.lit(SUGGEST_NUDGE))
            .otherwise(F.lit(SUGGEST_MONITOR)))
