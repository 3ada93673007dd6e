"""retentio — customer-risk and retention analytics as Spark DataFrame operators.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects (or
Spark ML models) and builds a lazy logical plan; Catalyst and AQE choose the
physical strategy.  See README.md for the operator map.
"""

from retentio.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
