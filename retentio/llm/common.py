"""Helpers shared by the operators: cleaned inputs and scratch tables in the shared folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to a Python worker at once where whole texts do.
BATCH_BYTES = "8m"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): a null text is the empty text; other columns are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def with_key(docs: DataFrame) -> DataFrame:
    """``id_and_text`` plus (d, t), the key that joins results back to rows: the doc_id with a
    stand-in for null, and a hash of the text.  It depends on the row alone, so a recomputed task
    gives the same key; rows equal in doc_id and text share it and count as one document."""
    return id_and_text(docs).withColumns({"d": F.coalesce("doc_id", F.lit(-2**63)), "t": F.xxhash64("text")})


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scratch_base(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local session with neither gets a temporary folder; on a cluster
    that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="retentio-scratch-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Actions inside hand rows to Python in batches of ``BATCH_BYTES``, unless the session sets its own
    size: a batch lies in the executor's JVM and in the worker, beside the heap in both."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key)


class Scratch:
    """Written tables of one run below the shared folder: they cut lineage, and a lost
    executor costs only its own tasks.  ``drop`` deletes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def table(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of steps whose results are written."""
        for _ in range(2):  # what the first collection lets go of frees more in the second
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of bigint, without Python.

    Sums run inside blocks of 256 elements, then the blocks are shifted by the
    totals before them, so an array of n elements costs n*256 copies, not n*n.
    """
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<bigint>")

    def push(acc, x):
        return F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero) + x))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / 256).cast("int")),
                         lambda i: F.aggregate(F.slice(values, i * 256 + 1, F.lit(256)), empty, push))
    before = lambda bs: F.aggregate(
        bs, F.array(zero), lambda acc, b: F.concat(
            acc, F.array(F.element_at(acc, F.lit(-1)) + F.coalesce(F.try_element_at(b, F.lit(-1)), zero))))
    shifted = F.transform(F.array(F.struct(blocks.alias("b"))),
                          lambda s: F.struct(s["b"].alias("b"), before(s["b"]).alias("o")))
    out = F.flatten(F.flatten(F.transform(
        shifted, lambda s: F.transform(
            F.arrays_zip(s["b"].alias("b"), F.slice(s["o"], F.lit(1), F.size(s["b"])).alias("o")),
            lambda p: F.transform(p["b"], lambda x: x + p["o"])))))
    return F.when(F.size(values) > 0, out).otherwise(empty)


