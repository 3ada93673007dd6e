"""Feedback text -> one vector per customer (M1), vector widening (M2) and the
embedding join (J2).

Default encoder ``hashing``: a stateless hashed bag of words (RegexTokenizer
+ HashingTF on the JVM), summed per customer and L2-normalised.  Term counts
add up over concatenation, so the vector of a customer's joined feedback is
the sum of per-row vectors: rows are encoded where they are and summed with a
partial aggregate, and a customer with a third of all feedback never lands
whole in one task or one string.

``svd-<dim>`` names the encoder of ``operators.lsa``, which is fitted on the
corpus (document frequencies and truncated SVD) and saved with the model; a
fitted one is passed as the object itself.

Any other encoder (e.g. a sentence model available on the workers) plugs in
through ``embed_texts`` as an Arrow-batched ``predict_batch_udf`` over the
joined text of each customer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.resolve import with_text_column
from retentio.operators.features import KEY, feedback_text
from retentio.operators.lsa import EMBEDDING, TextSvd

DEFAULT_DIM = 64
DEFAULT_ENCODER = f"hashing-{DEFAULT_DIM}"


def hashing_dim(name: str) -> int | None:
    if name.startswith("hashing-"):
        return int(name.split("-", 1)[1])
    return None


def hashed_term_vectors(feedback: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame | None:
    """customer_id, emb_vector (array<float>): L2-normalised hashed term counts
    of all the customer's non-null feedback text."""
    if feedback is None or KEY not in feedback.columns:
        return None
    fb = with_text_column(feedback)
    if fb is None:
        return None
    fb = fb.where(F.col(KEY).isNotNull()).select(KEY, F.coalesce("feedback_text", F.lit("")).alias("_t"))
    tok = RegexTokenizer(inputCol="_t", outputCol="_tok", pattern="(?U)\\W+", gaps=True, toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    rows = tf.transform(tok.transform(fb)).select(KEY, "_tf")
    summed = rows.groupBy(KEY).agg(Summarizer.sum(F.col("_tf")).alias("_v"))
    arr = vector_to_array("_v")
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x))
    vec = F.when(norm > 0, F.transform(arr, lambda x: x / norm)).otherwise(arr)
    return summed.select(KEY, vec.cast(T.ArrayType(T.FloatType())).alias(EMBEDDING))


def embed_texts(texts: DataFrame, make_predict_fn: Callable, dim: int, batch_size: int = 256,
                text_col: str = "feedback_text") -> DataFrame:
    """customer_id, emb_vector via an Arrow-batched model UDF.

    ``make_predict_fn()`` runs once per Python worker and returns
    ``fn(np.ndarray[str]) -> np.ndarray[float, (n, dim)]``.
    """
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size)
    return texts.select(KEY, udf(F.col(text_col)).alias(EMBEDDING))


def feedback_embeddings(feedback: DataFrame | None, encoder: str | Callable | None = DEFAULT_ENCODER,
                        dim: int | None = None, order_by: str = "feedback_id") -> DataFrame | None:
    """One vector per customer with feedback (M1); None when there is no
    usable feedback or ``encoder`` is None (text features left out)."""
    if encoder is None or feedback is None:
        return None
    if isinstance(encoder, TextSvd):
        return encoder.encode(feedback)
    if isinstance(encoder, str):
        d = hashing_dim(encoder)
        if d is None:
            raise ValueError(f"unknown encoder {encoder!r}; pass a predict-fn factory instead")
        return hashed_term_vectors(feedback, d)
    if dim is None:
        raise ValueError("dim is required for a custom encoder")
    texts = feedback_text(feedback, order_by=order_by)
    if texts is None:
        return None
    return embed_texts(texts, encoder, dim)


def precomputed_embeddings(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """customer_id, emb_vector from a table of precomputed vectors."""
    return vectors.where(F.col(KEY).isNotNull()).select(
        F.col(KEY).cast("string").alias(KEY), F.col(column).cast(T.ArrayType(T.FloatType())).alias(EMBEDDING))


def join_embeddings(features: DataFrame, vectors: DataFrame | None, dim: int | None = None,
                    fill_zero: bool = True) -> DataFrame:
    """features LEFT JOIN vectors on customer_id (J2); with ``fill_zero`` a
    customer without a vector gets the zero vector (missing features are 0)."""
    if vectors is None:
        return features
    df = features.join(vectors.select(KEY, EMBEDDING), KEY, "left")
    if fill_zero:
        if dim is None:
            raise ValueError("dim is required to zero-fill missing vectors")
        zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
        df = df.withColumn(EMBEDDING, F.coalesce(F.col(EMBEDDING), zero))
    return df


def widen(df: DataFrame, dim: int, column: str = EMBEDDING, prefix: str = "emb_") -> DataFrame:
    """Replace the vector column by ``emb_0 .. emb_{dim-1}`` (export only)."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, *[F.col(column)[i].alias(f"{prefix}{i}") for i in range(dim)])
