"""Line dedup over overlapping three-line windows (native).

Every three consecutive lines of a document are hashed; windows that occur
more than once anywhere are found by one pre-aggregated grouping on the hash.
The first occurrence, by (doc_id, text hash, line), stays; the lines of every
later occurrence are merged into covered runs and removed.

Defined cases: null or empty text is one empty line and has no window; a
document of fewer than three lines is left alone; windows whose three lines
are all blank are not counted; rows with a null doc_id come first in the
order; rows equal in doc_id and text count as one document and get the same
result; extra columns pass through ``dedup_lines`` and the query leaves them
out.  A window that overlaps a repeat of itself counts too: in five equal
lines, the first window is the first occurrence, the next two cover lines 1 to
4, and line 0 stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.llm.common import load, sha256_hex, with_key

WINDOW = 3
KEY = ["d", "t"]


def window_rows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(d, t, text) -> (d, t, pos, h1, h2) for each window of ``size`` lines; two hashes with
    different functions stand for the window's text."""
    lines = docs.select(*KEY, F.split("text", "\n", -1).alias("lines"))
    starts = F.when(F.size("lines") >= size, F.sequence(F.lit(0), F.size("lines") - size))
    rows = lines.select(*KEY, F.explode(F.transform(starts, lambda i: F.struct(
        i.alias("pos"), F.concat_ws("\n", F.slice("lines", i + 1, F.lit(size))).alias("w")))).alias("x"))
    return (rows.where(F.col("x.w").rlike(r"\S"))
            .select(*KEY, F.col("x.pos").alias("pos"), F.xxhash64("x.w").alias("h1"),
                    F.hash("x.w", F.length("x.w")).alias("h2")))


def covered_runs(windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """(d, t, runs): the merged runs (first line, line after the last) of a document that windows
    with an earlier occurrence cover."""
    first = (windows.groupBy("h1", "h2")
             .agg(F.min(F.struct(*KEY, "pos")).alias("first"), F.max(F.struct(*KEY, "pos")).alias("last"))
             .where("first != last").select("h1", "h2", "first"))
    later = windows.join(first, ["h1", "h2"]).where(F.struct(*KEY, "pos") != F.col("first")).select(*KEY, "pos")
    by_doc = Window.partitionBy(*KEY).orderBy("pos")
    # a run goes on while the next window starts within `size` lines of the one before
    opens = F.coalesce(F.col("pos") - F.lag("pos").over(by_doc) > size, F.lit(True))
    islands = (later.distinct().withColumn("opens", opens.cast("int"))
               .withColumn("run", F.sum("opens").over(by_doc)))
    runs = islands.groupBy(*KEY, "run").agg(F.min("pos").alias("from"), (F.max("pos") + size).alias("to"))
    return runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))


def outside(lines: Column, runs: Column) -> Column:
    """The lines outside ``runs`` (sorted, disjoint), by slicing between them."""
    after = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["to"]))
    until = F.concat(F.transform(runs, lambda r: r["from"]), F.array(F.size(lines)))
    gaps = F.arrays_zip(after.alias("a"), until.alias("b"))
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Each row of ``docs`` as ``row`` (a struct of all its columns) with ``kept`` (the text that
    remains), ``n_lines`` and ``n_removed``."""
    keyed = with_key(docs)
    runs = covered_runs(window_rows(keyed, size), size)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"),
                       F.coalesce(docs["doc_id"].cast("long"), F.lit(-2**63)).alias("d"), F.xxhash64(text).alias("t"))
    none = F.array().cast("array<struct<from:int,to:int>>")
    cut = rows.join(runs, KEY, "left").select(
        "row", "text", F.split("text", "\n", -1).alias("lines"), F.coalesce("runs", none).alias("runs"))
    n_removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["to"] - r["from"]))
    return cut.select("row", F.size("lines").cast("long").alias("n_lines"), n_removed.alias("n_removed"),
                      F.when(F.size("runs") == 0, F.col("text")).otherwise(
                          F.array_join(outside(F.col("lines"), F.col("runs")), "\n")).alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", sha256_hex("kept").alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, line,
             line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS win
      FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, line,
             CASE WHEN regexp_matches(win, '[^ \\t\\n\\x0B\\f\\r]') THEN
               row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 ELSE false END AS later
      FROM w),
c AS (SELECT doc_id, pos, line,
             coalesce(max(later::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM r)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM c GROUP BY doc_id
"""
