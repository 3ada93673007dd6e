"""Exact, interpolated percentiles without gathering a group in one task (A6, A10).

Spark's exact ``percentile`` keeps every distinct value of a group in one
hash map on one reducer; ``percentile_approx`` is bounded but approximate.
Here values are first collapsed to (value, count) — a partial aggregate, so a
value repeated a billion times is one row — then ranked exactly with
``running_totals`` over quantile buckets, and the rows covering the wanted
ranks are picked with one more aggregate.  Interpolation is linear between
the values at ranks floor(p*(n-1)) and floor(p*(n-1)) + 1 (pandas/DuckDB
``quantile_cont``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators.ranking import quantile_bucket, running_totals
from retentio.operators.selection import EXACT_ROWS, narrowed_percentiles


def _name(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "_")


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                      names: Sequence[str] | None = None, buckets: int = 1024,
                      relative_error: float | None = None, narrowing: bool = False,
                      exact_rows: int = EXACT_ROWS) -> DataFrame:
    """One row per ``by`` group with one column per probability.

    NULL values are ignored; a group without values gets no row (and a global
    call returns NULLs).  ``relative_error`` switches to ``percentile_approx``.
    ``narrowing`` gives the same exact values by ``operators.selection``: jobs
    run at once, but values are never shuffled (groups of up to ``exact_rows``
    values apart); without it all distinct values are, and nothing runs yet.
    """
    by = list(by)
    names = list(names) if names else [_name(p) for p in probs]
    if narrowing and relative_error is None:
        return narrowed_percentiles(df, value, probs, by, names, exact_rows)
    base = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if relative_error is not None:
        acc = max(1, int(round(1.0 / relative_error)))
        aggs = [F.percentile_approx("_v", float(p), acc).alias(n) for p, n in zip(probs, names)]
        return base.groupBy(*by).agg(*aggs)

    vals = base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    vals = quantile_bucket(vals, "_v", buckets=buckets)
    # the group size comes with the bucket offsets (no extra pass or join)
    cum = running_totals(vals, ["_v"], ["_cnt"], by=by, bucket="_b", with_totals=True)
    cum = cum.withColumnRenamed("_cnt_total", "_n")
    start = F.col("_cnt_cum") - F.col("_cnt")
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("_n") - 1)
        covers_lo = (start <= lo) & (lo < F.col("_cnt_cum"))
        covers_hi = (start <= hi) & (hi < F.col("_cnt_cum"))
        aggs += [F.max(F.when(covers_lo, F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when(covers_hi, F.col("_v"))).alias(f"_hi{i}"),
                 F.max(pos - lo).alias(f"_f{i}")]
    picked = cum.groupBy(*by).agg(*aggs)
    out = [F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
           for i in range(len(probs))]
    return picked.select(*by, *[c.alias(n) for c, n in zip(out, names)])
