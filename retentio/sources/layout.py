"""Tables laid out by key: joins without exchange, and lookups that read one bucket.

A bucketed table is written once, hashed by its keys into a fixed number of
buckets and sorted inside them.  Tables with equal keys and bucket counts join
and aggregate where they lie.  For a lookup by key Spark reads one bucket, and
inside it Parquet's statistics and bloom filter pass over row groups without
the key.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from retentio.session import scratch_dir

BUCKETS = 64


def publish_bucketed(df: DataFrame, keys: Sequence[str] | str, buckets: int = BUCKETS, name: str | None = None,
                     path: str | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` bucketed by ``keys`` and return the table read back.

    ``path`` is the table's folder (default: a fresh one below the shared
    checkpoint folder), ``name`` its name in the session's catalog.  Rows are
    dealt to their bucket before the write, so a bucket is one file; rows of one
    key beyond that lie in the same bucket, as any layout by key has it.
    """
    spark, keys = df.sparkSession, [keys] if isinstance(keys, str) else list(keys)
    name = name or f"retentio_{uuid.uuid4().hex[:12]}"
    path = path or scratch_dir(spark, name)
    writer = (df.repartition(buckets, *keys).write.format("parquet").mode("overwrite")
              .option("path", path).bucketBy(buckets, *keys).sortBy(*keys, *order_by))
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.saveAsTable(name)
    return spark.table(name)
