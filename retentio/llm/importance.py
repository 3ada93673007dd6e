"""Quality by importance resampling.

Texts are bags of hashed n-grams: words, word pairs and pairs of word shapes
(letters as a or A, digits as 0, runs cut to two).  A generative model of the
target (texts labelled good) and one of the raw corpus give each text the
log-ratio of its probabilities, its log importance weight; the k largest of
weight plus Gumbel noise are a sample without replacement by importance.

The raw model counts every document.  The target model is fitted on at most
``TARGET_ROWS`` labelled rows.  ``good_share`` fixes k: the good documents that
the target model has not seen are scored too, and k is the number of documents
at or above the score that this share of them reaches.  Both models are tables
of ``BUCKETS`` counts whatever the corpus size, and the k-th score is found by
narrowing histograms, so neither texts nor scores gather anywhere.

Defined cases: null or empty text has no n-gram and weight 0; documents that
tie with the k-th are all selected; without labels of both halves every
document is selected; a label row with a null doc_id or quality is ignored;
rows equal in doc_id and text get the same noise; extra columns pass through
``select_rows``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, load, small_batches
from retentio.llm.tokens import buffers, from_buffers, large, text_chunks

BUCKETS = 1 << 16
TARGET_ROWS = 50_000
GOOD_SHARE = 0.998
SEED = 17

def shapes(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """The texts with a-z and non-ASCII bytes as a, A-Z as A, digits as 0, and at most two equal ones in
    a row: each word's place holds its shape."""
    raw, off = buffers(texts)
    kind = np.arange(256, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = ord("a"), ord("A"), ord("0"), ord("a")
    raw = kind[raw]
    keep = np.ones(len(raw), bool)
    keep[2:] = (raw[2:] != raw[1:-1]) | (raw[1:-1] != raw[:-2])
    # the first bytes of a text do not continue the text before
    starts = off[:-1][np.diff(off) > 0]
    keep[starts] = True
    keep[starts[starts + 1 < len(raw)] + 1] = True
    return from_buffers(raw[keep], np.r_[0, np.cumsum(keep)][off])


def words_of(texts: pa.LargeStringArray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets of the texts in them)."""
    split = pc.ascii_split_whitespace(texts)
    off = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    # splitting leaves empty strings at the ends of a text
    real = np.fromiter((w != "" for w in words), bool, len(words))[codes]
    return hashes[codes[real]], np.r_[0, np.cumsum(real)][off - off[0]]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, offsets of the texts in them)."""
    texts = large(texts)
    w, off = words_of(texts, 0)
    s = words_of(shapes(texts), 1)[0]
    if not len(w):
        return np.zeros(0, np.int64), off

    def pairs(x):
        y = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]
        return (y ^ (y >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(48)

    # three features for each word, the last word's pairs apart
    out = np.stack([w >> np.uint64(48), np.r_[pairs(w), np.uint64(0)][:len(w)], np.r_[pairs(s), np.uint64(0)][:len(w)]], axis=1)
    use = np.ones(out.shape, bool)
    use[off[1:][np.diff(off) > 0] - 1, 1:] = False
    n = np.r_[0, np.cumsum(use.sum(axis=1))]
    return out[use].astype(np.int64) % BUCKETS, n[off]


def counts(docs: DataFrame, target_ids: np.ndarray) -> np.ndarray:
    """(2, BUCKETS): n-gram counts of the corpus and of the documents in ``target_ids`` (sorted)."""
    shared = docs.sparkSession.sparkContext.broadcast(target_ids)

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for rows in text_chunks(batch, "text"):
                f, off = features(rows.column("text"))
                raw += np.bincount(f, minlength=BUCKETS)
                mine = np.isin(pc.fill_null(rows.column("doc_id"), -2**63).to_numpy(), shared.value)
                target += np.bincount(f[np.repeat(mine, np.diff(off))], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "raw": raw[used], "target": target[used]})

    got = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
           .mapInArrow(run, "bucket int, raw long, target long")
           .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    out = np.zeros((2, BUCKETS), np.int64)
    out[:, got.column("bucket").to_numpy()] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    return out


def log_ratios(count: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one added to every count."""
    p = (count + 1.0) / (count.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def weighted(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Each row of ``docs`` as ``row`` with ``n_ngrams`` and ``log_weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    kind = rows.schema["row"].dataType
    at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    inside = docs.dtypes[at][1] == "string"
    if inside:  # the text goes to Python once, in its row
        rows = rows.select("row")

    def run(batches):
        for batch in batches:
            if inside:
                row = batch.column("row")
                batch = pa.RecordBatch.from_arrays([row, row.field(at)], names=["row", "text"])
            for part in text_chunks(batch, "text"):
                f, off = features(part.column("text"))
                value, n = shared.value[f], np.diff(off)
                weight = np.zeros(len(n))
                if len(f):
                    weight[n > 0] = np.add.reduceat(value, off[:-1][n > 0])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n), pa.array(weight)],
                                                 names=["row", "n_ngrams", "log_weight"])

    return rows.mapInArrow(run, f"row {kind.simpleString()}, n_ngrams long, log_weight double")


def gumbel(seed: int, *keys: Column) -> Column:
    """Gumbel noise that depends on the row alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / 2.0**53
    return -F.log(-F.log(u))


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """The k-th largest value (null values apart), by histograms over ever narrower ranges."""
    x = F.col(column)
    lo, hi, n = scores.where(x.isNotNull()).agg(F.min(x), F.max(x), F.count(x)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while lo < hi:
        width = (hi - lo) / bins
        bin_ = F.least(F.floor((x - lo) / width), F.lit(bins - 1)) if width > 0 else F.when(x == hi, 1).otherwise(0)
        rows = (scores.where((x >= lo) & (x <= hi)).groupBy(bin_.alias("bin"))
                .agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect())  # at most `bins` rows
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return hi


def select_top(scored: DataFrame, column: str, k: int) -> DataFrame:
    """``scored`` with ``selected``: the value is among the k largest, ties with the k-th included."""
    edge = kth_largest(scored, column, k)
    return scored.withColumn("selected", F.lit(False) if edge is None else F.col(column) >= F.lit(edge))


def select_rows(docs: DataFrame, labels: DataFrame, good_share: float = GOOD_SHARE,
                target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """Each row of ``docs`` as ``row`` with n_ngrams, log_weight, score (with noise) and selected."""
    scratch = Scratch(docs.sparkSession, "importance")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(labels["doc_id"].cast("long").alias("id")).distinct()
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    # at most target_rows ids: the bounded sample that the target model is fitted on
    target = good.where(half == 0).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(target_rows).toArrow()
    ids = np.sort(target.column("id").to_numpy())
    with small_batches(docs.sparkSession):
        ratios = log_ratios(counts(docs, ids))
    rows = weighted(docs, ratios)
    noise = gumbel(seed, F.col("row.doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    with small_batches(docs.sparkSession):
        rows = scratch.table(rows.withColumn("score", F.col("log_weight") + noise))
    scores = rows.select(F.col("row.doc_id").cast("long").alias("id"), "score")
    held = scores.join(good.where(half == 1), "id").select("score")
    n_held = held.count()
    edge = kth_largest(held, "score", max(1, int(np.ceil(good_share * n_held)))) if n_held and len(ids) else None
    k = scores.where(F.col("score") >= F.lit(edge)).count() if edge is not None else scores.count()
    return select_top(rows, "score", k)


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = select_rows(docs, load(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "n_ngrams", "log_weight", "score", "selected")
