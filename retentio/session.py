"""Spark session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on for correct results (UTC day arithmetic) and
# for scale (AQE re-plans joins and coalesces/splits partitions at run time).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app_name: str = "retentio",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster call it without ``master``; the launcher decides.  Tests pass
    ``local[N]`` and a small shuffle partition count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in SESSION_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_base(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` / the context's
    checkpoint dir.  Only a local-mode session (tests) without either gets a
    temp folder; on a cluster an unset folder is an error, never a
    machine-local path."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(checkpoints and scratch tables go there)")
        base = conf or tempfile.mkdtemp(prefix="retentio-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh directory below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or the context's checkpoint
    dir).  Only when neither is set — local tests — a directory under the
    system temp folder is created and registered as the checkpoint dir.
    """
    base = checkpoint_base(spark)
    sub = f"{name or 'scratch'}-{uuid.uuid4().hex[:12]}"
    return base.rstrip("/") + "/" + sub
