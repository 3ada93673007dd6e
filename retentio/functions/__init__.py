"""Column-level building blocks: every helper returns a native Spark ``Column``
(no Python UDFs), so expressions stay inside whole-stage codegen."""

from retentio.functions.columns import (  # noqa: F401
    AS_OF_DEFAULT, DATE_FORMATS, clip01, exact_mean, intervention, nan_to_null,
    normalize_key, parse_date, risk_band, whole_days_between,
)
from retentio.functions.resolve import first_present, resolve_columns  # noqa: F401
