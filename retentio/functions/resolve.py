"""Driver-side schema resolution (S6): pick columns by name, no data touched."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate column the frame has, or None."""
    cols = set(df.columns)
    return next((c for c in candidates if c in cols), None)


def resolve_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """Wanted columns the frame has, in the wanted order (display projections)."""
    cols = set(df.columns)
    return [c for c in wanted if c in cols]


def with_text_column(df: DataFrame, target: str = "feedback_text",
                     alternatives: Sequence[str] = ("text",)) -> DataFrame | None:
    """Frame with ``target`` present (renaming the first alternative), else None."""
    if target in df.columns:
        return df
    alt = first_present(df, alternatives)
    if alt is None:
        return None
    return df.withColumnRenamed(alt, target)
