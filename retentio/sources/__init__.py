"""Sources and sinks: CSV/Parquet tables, prediction export, model artifacts,
and views that map the driver's test tables onto the retention schema."""

from retentio.sources.tables import preview, read_table, write_predictions  # noqa: F401
