"""Centroid clustering by equal-average equal-variance search.

Vectors are integers (``floor(scale * x)``), so distances, ties and means are
exact.  Centroids are sorted by the sum of their components.  A vector's search
starts at its own sum and goes outward, always to the nearer side.  With d
components, sums S and deviations A = sqrt(d * sum(x^2) - S^2),

    d * |x - c|^2  >=  (S_x - S_c)^2 + (A_x - A_c)^2,

so the search ends where the squared difference of sums alone exceeds d times
the best distance so far, a centroid whose bound exceeds it is passed over, and
only the rest are measured, in whole numbers.  Rejection is strict (with a
margin for the roots), so equal distances still go to the smaller number.

Each round is one pass over the written vectors: tasks add up their clusters'
sums, Spark adds up the tasks, and the driver sees one row per centroid.  The
codebook (``k`` rows of ``dim`` numbers) is all that is broadcast.

Defined cases: vectors of other than ``dim`` components, null, or with a null or
non-finite component are left out, and so are those with a scaled component
beyond ``LIMIT``, whose squared distances fit no long; a null vec_id is
clustered but is no first centroid; repeated rows count each, and of equal
hashes the smaller vector comes first; fewer vectors with an id than ``k`` give
fewer centroids; without any, no row comes out; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, load
from retentio.llm.vectors import matrix, scaled

DIM, SCALE, K, ROUNDS = 64, 64, 16, 3
LIMIT = 1 << 27
#: Up to this size of components, all that is computed fits 64 bits.
SMALL = 1 << 23


class Codebook:
    """Centroids in the order of their sums."""

    def __init__(self, centroids: list[list[int]]):
        whole = np.asarray(centroids, object)
        self.number = np.asarray(sorted(range(len(centroids)), key=lambda i: (sum(centroids[i]), i)))
        self.rows = whole[self.number]
        self.largest = max((abs(x) for c in centroids for x in c), default=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid; equal ones: the smaller number."""
        n, d = x.shape
        k = len(self.rows)
        # beyond 64 bits: the same in Python's whole numbers
        kind = np.int64 if max(self.largest, int(np.abs(x).max(initial=0))) <= SMALL else object
        x, rows = x.astype(kind), self.rows.astype(kind)
        sums, own = rows.sum(1), x.sum(1)
        spread = np.sqrt((d * (rows * rows).sum(1) - sums * sums).astype(float))
        own_spread = np.sqrt((d * (x * x).sum(1) - own * own).astype(float))
        right = np.searchsorted(sums, own)
        left = right - 1
        best, at = np.zeros(n, kind), np.full(n, -1)
        alive = np.arange(n)
        for _ in range(k):
            lo, hi, s = left[alive], right[alive], own[alive]
            down = s - sums[np.maximum(lo, 0)]
            up = sums[np.minimum(hi, k - 1)] - s
            go_left = (lo >= 0) & ((hi >= k) | (down <= up))
            j, gap = np.where(go_left, lo, hi), np.where(go_left, down, up)
            found, limit = at[alive] >= 0, d * best[alive]
            within = ~found | (gap * gap <= limit)
            # the nearer side is too far, so all that is left is
            alive, j, gap, go_left, found, limit = (v[within] for v in (alive, j, gap, go_left, found, limit))
            if not len(alive):
                break
            left[alive] -= go_left
            right[alive] += ~go_left
            a, b = own_spread[alive], spread[j]
            apart = np.maximum(0.0, np.abs(a - b) - (a + b + 1.0) * 1e-12)
            near = ~found | ((gap * gap).astype(float) + apart * apart <= limit.astype(float) * (1 + 1e-12))
            i, j = alive[near], j[near]
            diff = x[i] - rows[j]
            dist, number = (diff * diff).sum(1), self.number[j]
            better = (at[i] < 0) | (dist < best[i]) | (dist == best[i]) & (number < at[i])
            best[i[better]], at[i[better]] = dist[better], number[better]
            alive = alive[(left[alive] >= 0) | (right[alive] < k)]
        return at, best


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id long, x array<int>) of the vectors that are kept."""
    return (vectors.where(F.size(vectors["embedding"]) == dim)
            .select(vectors["vec_id"].cast("long").alias("vec_id"), scaled(vectors["embedding"], scale, LIMIT).alias("x"))
            .where("x IS NOT NULL"))


def first_centroids(x: DataFrame, k: int = K) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of their ids, in that order."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in x.where("vec_id IS NOT NULL").orderBy(name, "x").limit(k).collect()]


def cluster_sums(x: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster: number of vectors and the sum of each component."""
    dim = len(centroids[0])
    shared = x.sparkSession.sparkContext.broadcast(Codebook(centroids))

    def run(batches):
        book = shared.value
        total, count = np.zeros((len(book.rows), dim), np.int64), np.zeros(len(book.rows), np.int64)
        for batch in batches:
            rows = matrix(batch.column("x"), dim)
            at, _ = book.nearest(rows)
            np.add.at(total, at, rows)
            count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    rows = (x.select("x").mapInArrow(run, "cluster int, n long, sums array<long>").groupBy("cluster")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")).collect())
    return {r["cluster"]: (r["n"], list(r["sums"])) for r in rows}


def fit_centroids(x: DataFrame, k: int = K, rounds: int = ROUNDS) -> list[list[int]]:
    """Final centroids; an empty cluster keeps its own."""
    centroids = first_centroids(x, k)
    for _ in range(rounds if centroids else 0):
        for i, (n, sums) in cluster_sums(x, centroids).items():
            centroids[i] = [s // n for s in sums]
    return centroids


def assign(x: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    dim = len(centroids[0])
    shared = x.sparkSession.sparkContext.broadcast(Codebook(centroids))

    def run(batches):
        for batch in batches:
            at, dist = shared.value.nearest(matrix(batch.column("x"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array(dist.tolist(), pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return x.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and the
    centroid itself.  An inertia that fits no long is null."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    x = scratch.table(integer_vectors(vectors, dim, scale))
    centroids = fit_centroids(x, k, rounds)
    schema = "cluster int, centroid array<int>, centroid_sha256 string"
    book = spark.createDataFrame(
        [(i, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], schema)
    near = scratch.table(assign(x, centroids) if centroids else
                         x.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0))
    scratch.drop(x)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = near.groupBy("cluster").agg(exact.alias("sum"))
    total = per.agg(F.sum("sum").cast("decimal(38,0)").alias("all"))
    # one row per centroid
    told = (book.join(per, "cluster").join(F.broadcast(total))
            .select("cluster", F.col("sum").try_cast("long").alias("cluster_inertia"),
                    F.col("all").try_cast("long").alias("inertia"), "centroid_sha256", "centroid"))
    return near.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(load(spark, sf_dir, "embeddings")).drop("centroid")


def _oracle() -> str:
    parts = ["""v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings WHERE len(embedding) = 64
    AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS cluster, x AS c
  FROM v WHERE vec_id IS NOT NULL
  QUALIFY cluster < 16)"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS (
  SELECT vec_id, x, min(struct_pack(d := d, cluster := cluster)) AS best FROM (
    SELECT n, vec_id, x, cluster, CAST(list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, 65)]) AS BIGINT) AS d
    FROM (SELECT *, row_number() OVER () AS n FROM v), c{r})
  GROUP BY n, vec_id, x)""")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (
  SELECT cluster, list(m ORDER BY i) AS c FROM (
    SELECT best.cluster AS cluster, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n,
           (s - ((s % n) + n) % n) // n AS m
    FROM a{r}, range(1, 65) AS t(i) GROUP BY best.cluster, i) GROUP BY cluster),
c{r + 1} AS (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON best.cluster = c{ROUNDS}.cluster"""


ORACLE = _oracle()
