"""Fitted text encoder (M1): hashed TF-IDF, then truncated SVD of the corpus.

Terms are letters and digits in lower case, hashed into ``buckets`` (md5, so
any engine names the same bucket).  Texts are cut into terms on the JVM; tasks
hash each distinct term of an Arrow batch once, however often it comes up.
Fitting takes two passes over the feedback:

1. document frequencies per bucket, giving ``idf = ln((n + 1) / (df + 1))``;
2. the Gram matrix of the weighted, unit-length term vectors.  Each task adds
   up its rows' outer products, Spark adds up the tasks row by row, and the
   ``buckets x buckets`` sum - a fixed size, whatever the corpus - is
   decomposed on the driver.  Its leading eigenvectors are the right singular
   vectors of the whole term matrix.

A text's vector is its weighted term counts projected on these and scaled to
unit length.  Before the scaling this adds up over concatenation, so rows are
projected where they are and summed per customer; nobody's whole text is put
together.  Null and empty texts, and texts of unseen weight only, add the zero
vector; a customer with nothing else keeps the zero vector.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.resolve import with_text_column
from retentio.operators.features import KEY

EMBEDDING = "emb_vector"
BUCKETS = 512
#: Fixed value: what separates terms.
SEPARATORS = r"[^\p{L}\p{N}]+"
#: Rows that a task holds as dense term vectors at a time.
CHUNK = 1024

# the functions that run in tasks travel with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def split_terms(text: Column) -> Column:
    """Terms of a text in order, empty strings among them; none for a null text."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements of a list column, and its offsets among them."""
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(off[0], off[-1] - off[0]), off - off[0]


def term_buckets(terms: pa.Array, buckets: int = BUCKETS) -> pa.Array:
    """Buckets of lists of terms, repetitions included, empty strings left out."""
    flat, off = _flat(terms)
    coded = flat.dictionary_encode()
    # hash_int's first 15 hex digits; -1 for the empty string
    named = np.asarray([int(hashlib.md5(t).hexdigest()[:15], 16) % buckets if t else -1
                        for t in coded.dictionary.cast(pa.binary()).to_pylist()], np.int32)
    at = named[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int32)
    held = at >= 0
    kept = np.r_[0, np.cumsum(held)][off]
    return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(at[held]))


def feedback_terms(feedback: DataFrame, buckets: int = BUCKETS) -> DataFrame | None:
    """(customer_id, terms) of every feedback row with a customer; None without a text or key column."""
    if feedback is None or KEY not in feedback.columns:
        return None
    fb = with_text_column(feedback)
    if fb is None:
        return None
    fb = fb.where(F.col(KEY).isNotNull()).select(KEY, split_terms(F.col("feedback_text")).alias("terms"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(KEY), term_buckets(batch.column("terms"), buckets)], names=[KEY, "terms"])

    return fb.mapInArrow(run, f"{KEY} {fb.schema[KEY].dataType.simpleString()}, terms array<int>")


def inverse_document_frequencies(terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, df, idf) of every bucket; rows without a term are no documents."""
    def run(batches):
        # the last place counts the documents
        total = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                held = counted(batch.column("terms").slice(a, CHUNK), buckets) > 0
                total += np.r_[held.sum(0), held.any(1).sum()]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "df"])

    # one row a task and bucket is shuffled
    df = terms.select("terms").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    every = terms.sparkSession.range(buckets + 1).withColumnRenamed("id", "bucket").join(df, "bucket", "left")
    w = Window.partitionBy()  # over the table of buckets
    every = every.select("bucket", F.coalesce("df", F.lit(0)).alias("df")).withColumn(
        "n", F.max(F.when(F.col("bucket") == buckets, F.col("df"))).over(w)).where(F.col("bucket") < buckets)
    return every.select(F.col("bucket").cast("int").alias("bucket"), "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def counted(terms: pa.Array, buckets: int) -> np.ndarray:
    """Term counts by bucket, one row a text."""
    flat, off = _flat(terms)
    row = np.repeat(np.arange(len(terms)), np.diff(off))
    return np.bincount(row * buckets + flat.to_numpy(zero_copy_only=False).astype(np.int64),
                       minlength=len(terms) * buckets).reshape(len(terms), buckets)


def dense(terms: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted term vectors, one row a text."""
    return counted(terms, len(idf)) * idf


def _rows(x: np.ndarray) -> pa.Array:
    """A matrix as a list column, one row each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def gram_matrix(terms: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Sum of the outer products of all unit-length term vectors."""
    def run(batches):
        total = np.zeros((len(idf), len(idf)))
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                x = dense(batch.column("terms").slice(a, CHUNK), idf)
                length = np.sqrt((x * x).sum(1))
                x = x[length > 0] / length[length > 0][:, None]
                total += x.T @ x
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), _rows(total[used])],
                                         names=["i", "row"])

    rows = (terms.select("terms").mapInArrow(run, "i int, row array<double>")
            .groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
            .select("i", vector_to_array("row").alias("row")).collect())  # at most `buckets` rows
    out = np.zeros((len(idf), len(idf)))
    for r in rows:
        out[r["i"]] = r["row"]
    return out


def leading_directions(gram: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), largest first; a vector's largest component
    is positive, and directions beyond the rank are zero."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    values, vectors = values[::-1][:dim], vectors[:, ::-1][:, :dim]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    vectors = np.where(values > 1e-9 * max(values.max(initial=0.0), 1e-300), vectors, 0.0)
    if vectors.shape[1] < dim:
        values = np.pad(values, (0, dim - len(values)))
        vectors = np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))
    return np.sqrt(np.maximum(values, 0.0)), vectors


@dataclass
class TextSvd:
    """A fitted encoder; ``to_dict`` and ``from_dict`` carry it in a model's metadata."""

    idf: list[float]
    singular_values: list[float]
    directions: list[list[float]]  # one row a bucket

    @property
    def dim(self) -> int:
        return len(self.singular_values)

    @property
    def name(self) -> str:
        return f"svd-{self.dim}"

    @classmethod
    def fit(cls, feedback: DataFrame, dim: int, buckets: int = BUCKETS) -> TextSvd | None:
        """Fit on all rows of the feedback; None when it has no text or key column."""
        terms = feedback_terms(feedback, buckets)
        if terms is None:
            return None
        idf = np.zeros(buckets)
        for r in inverse_document_frequencies(terms, buckets).collect():  # `buckets` rows
            idf[r["bucket"]] = r["idf"]
        values, directions = leading_directions(gram_matrix(terms, idf), dim)
        return cls(idf.tolist(), values.tolist(), directions.tolist())

    def to_dict(self) -> dict:
        return {"idf": self.idf, "singular_values": self.singular_values, "directions": self.directions}

    @classmethod
    def from_dict(cls, state: dict) -> TextSvd:
        return cls(**state)

    def encode(self, feedback: DataFrame) -> DataFrame | None:
        """customer_id, emb_vector (array<float>): unit-length projection of all of a customer's terms."""
        terms = feedback_terms(feedback, len(self.idf))
        if terms is None:
            return None
        key_type = terms.schema[KEY].dataType.simpleString()
        idf, directions = np.asarray(self.idf), np.asarray(self.directions)

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(a, CHUNK)
                    x = dense(part.column("terms"), idf) @ directions
                    yield pa.RecordBatch.from_arrays([part.column(KEY), _rows(x)], names=[KEY, "x"])

        summed = (terms.mapInArrow(run, f"{KEY} {key_type}, x array<double>")
                  .groupBy(KEY).agg(Summarizer.sum(array_to_vector("x")).alias("x")))
        x = vector_to_array("x")
        length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
        unit = F.when(length > 0, F.transform(x, lambda v: v / length)).otherwise(x)
        return summed.select(KEY, unit.cast(T.ArrayType(T.FloatType())).alias(EMBEDDING))


def svd_dim(name: str) -> int | None:
    """Vector length that an encoder name of this kind asks for."""
    return int(name.split("-", 1)[1]) if name.startswith("svd-") else None


def weighted_norms(feedback: DataFrame, buckets: int = BUCKETS) -> DataFrame | None:
    """(customer_id, n_terms, norm): terms of all of a customer's feedback and the length of its TF-IDF vector."""
    terms = feedback_terms(feedback, buckets)
    if terms is None:
        return None
    key_type = terms.schema[KEY].dataType.simpleString()

    def run(batches):
        for batch in batches:
            flat, off = _flat(batch.column("terms"))
            keys = batch.column(KEY).dictionary_encode()
            owner = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            cell, tf = np.unique(np.repeat(owner, np.diff(off)) * buckets + flat.to_numpy(zero_copy_only=False), return_counts=True)
            whose, bucket = np.divmod(cell, buckets)
            bare = np.setdiff1d(owner, whose)  # customers without a term keep a row
            yield pa.RecordBatch.from_arrays(
                [keys.dictionary.take(pa.array(np.r_[whose, bare])),
                 pa.array(np.r_[bucket, np.zeros(len(bare), np.int64)], pa.int32(), mask=np.arange(len(cell) + len(bare)) >= len(cell)),
                 pa.array(np.r_[tf, np.zeros(len(bare), np.int64)])], names=[KEY, "bucket", "tf"])

    # a row is a customer's count of a bucket in one batch
    counts = (terms.mapInArrow(run, f"{KEY} {key_type}, bucket int, tf long")
              .groupBy(KEY, "bucket").agg(F.sum("tf").alias("tf")))
    idf = inverse_document_frequencies(terms, buckets)
    weighted = counts.join(F.broadcast(idf), "bucket", "left")  # `buckets` rows
    w = F.coalesce(F.col("tf") * F.col("idf"), F.lit(0.0))
    return weighted.groupBy(KEY).agg(F.sum("tf").alias("n_terms"), F.sqrt(F.sum(w * w)).alias("norm"))
