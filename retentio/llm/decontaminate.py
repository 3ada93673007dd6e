"""Benchmark decontamination (native).

The distinct windows of the benchmark (10 consecutive words of an item; a
shorter item is one window) are hashed into a set of bits that goes to every
task: ``BITS_EACH`` bits for a window, and never more than ``MOST_BITS`` (8 MB),
which a larger benchmark only fills more.  Each document is cut into words once,
its windows of every length that the items have are hashed in place and tested
in the set; what hits leaves its row and is verified on the words themselves.

Defined cases: null or empty text has no words and is never hit; an item
without words has no window; items with equal ids count once; rows equal in
doc_id and text share one result; extra columns pass through ``drop_hit``
and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, ascii_lower, load, sha256_hex, with_key

WORDS = 10
#: Size of the hash set: bits for each window, and in all; each window sets ``PROBES`` of them.
BITS_EACH, MOST_BITS, PROBES = 16, 1 << 26, 4
# every character below 0x80 that is neither a digit nor a letter
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["d", "t"]


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS, -1), lambda w: w != "")


def windows(ws: Column, n: int) -> Column:
    """Start and hash of each run of ``n`` words."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(ws, i + 1, F.lit(n))).alias("h")))


def item_windows(items: DataFrame, n: int = WORDS) -> DataFrame:
    """(len, h, item_words, items): each distinct window of the items, with the ids it occurs in."""
    ws = items.select(F.col("item_id").cast("string").alias("item_id"),
                      words(F.coalesce(items["text"].cast("string"), F.lit(""))).alias("ws")).where(F.size("ws") > 0)
    ws = ws.withColumn("len", F.least(F.size("ws"), F.lit(n)))
    rows = ws.select("item_id", "len", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("ws") - F.col("len")),
        lambda i: F.slice("ws", i + 1, F.col("len")))).alias("item_words"))
    return (rows.groupBy("len", "item_words").agg(F.collect_set("item_id").alias("items"))
            .withColumn("h", F.xxhash64("item_words")))


def places(h: Column, size: int) -> list[Column]:
    """The bits of hash ``h`` in a set of ``size`` bits, a power of two."""
    low, high = h.bitwiseAND(F.lit(2**32 - 1)), F.shiftrightunsigned(h, 32)
    return [(low + high * j).bitwiseAND(F.lit(size - 1)) for j in range(PROBES)]


def bit_set(hashes: DataFrame, most: int = MOST_BITS) -> list[int]:
    """The set of all ``h``: numbers of 64 bits, at most ``most`` bits in all."""
    size = min(most, max(64, 1 << (BITS_EACH * hashes.count()).bit_length()))
    bits = hashes.select(F.explode(F.array(*places(F.col("h"), size))).alias("p"))
    words_ = bits.groupBy(F.shiftright("p", 6).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
    out = [0] * (size // 64)
    for at, w in zip(*words_.toArrow().to_pydict().values()):
        out[at] = w
    return out


def may_hold(bits: list[int], h: Column) -> Column:
    """Whether all bits of ``h`` are set; most hashes fail the first."""
    # one constant for the optimiser to fold, not a node for each number
    table = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")
    tests = [F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
             for p in places(h, 64 * len(bits))]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def hits(docs: DataFrame, items: DataFrame, n: int = WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """(d, t, pos, len, items): each verified occurrence of an item's window in a document."""
    found = Scratch(docs.sparkSession, "windows").table(item_windows(items, n))  # read three times
    # at most n numbers: the lengths that windows have
    lengths = sorted(r["len"] for r in found.select("len").distinct().collect()) or [n]
    bits = bit_set(found.select("h").distinct(), most_bits)
    ws = docs.select(*KEY, words(F.col("text")).alias("ws"))
    none = F.array().cast("array<struct<pos:int,h:bigint,len:int,item_words:array<string>>>")

    def of_length(k):
        hit = F.filter(windows(F.col("ws"), k), lambda x: may_hold(bits, x["h"]))
        return F.coalesce(F.transform(hit, lambda x: F.struct(
            x["pos"].alias("pos"), x["h"].alias("h"), F.lit(k).alias("len"),
            F.slice("ws", x["pos"] + 1, F.lit(k)).alias("item_words"))), none)

    x = ws.select(*KEY, F.explode(F.concat(*[of_length(k) for k in lengths])).alias("x")).select(*KEY, "x.*")
    return x.join(found, ["h", "len", "item_words"]).select(*KEY, "pos", "len", "items")


def hit_words(found: DataFrame) -> DataFrame:
    """(d, t, runs, n_hit, items): merged runs of hit words (first, after the last) and the items."""
    by_doc = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy(*KEY, "pos").agg(F.max("len").alias("len"))
    opens = F.coalesce(F.col("pos") > F.max(F.col("pos") + F.col("len")).over(by_doc), F.lit(True))
    islands = spans.withColumn("opens", opens.cast("int")).withColumn(
        "run", F.sum("opens").over(Window.partitionBy(*KEY).orderBy("pos")))
    runs = (islands.groupBy(*KEY, "run").agg(F.min("pos").alias("from"), F.max(F.col("pos") + F.col("len")).alias("to"))
            .groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"),
                               F.sum(F.col("to") - F.col("from")).cast("long").alias("n_hit")))
    ids = (found.select(*KEY, F.explode("items").alias("item")).distinct()
           .groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items")))
    return runs.join(ids, KEY)


def contamination(docs: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, runs, n_hit, items (null where nothing is hit)."""
    keyed = with_key(docs)
    found = Scratch(docs.sparkSession, "benchmark").table(hits(keyed, items, n))  # read twice, and few
    counted = keyed.select("doc_id", *KEY, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(hit_words(found), KEY, "left")


def drop_hit(docs: DataFrame, items: DataFrame, share: float = 0.0, n: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, less those with more than ``share`` of their words hit."""
    keyed = with_key(docs)
    found = hit_words(Scratch(docs.sparkSession, "benchmark").table(hits(keyed, items, n))).select(*KEY, "n_hit")
    if share > 0:
        counted = keyed.select(*KEY, F.size(words(F.col("text"))).alias("n_words"))
        found = found.join(counted, KEY).where(F.col("n_hit") > share * F.col("n_words"))
    # few rows: written, so that their size decides how they are joined
    found = Scratch(docs.sparkSession, "benchmark").table(found.select(*KEY).distinct())
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.coalesce(docs["doc_id"].cast("long"), F.lit(-2**63)).alias("d"), F.xxhash64(text).alias("t"))
    return rows.join(found, KEY, "left_anti").select("row.*")


def cut_hit(docs: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, text): each document's words outside the hit runs, joined by one space; a document
    without hits keeps its text unchanged."""
    keyed = with_key(docs)
    found = hit_words(hits(keyed, items, n)).select(*KEY, "runs")
    ws = words(F.col("text"))
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["to"])).alias("a"),
                        F.concat(F.transform("runs", lambda r: r["from"]), F.array(F.size("ws"))).alias("b"))
    rest = F.flatten(F.transform(gaps, lambda g: F.slice("ws", g["a"] + 1, g["b"] - g["a"])))
    return (keyed.join(found, KEY, "left").withColumn("ws", F.when(F.col("runs").isNotNull(), ws))
            .select("doc_id", F.when(F.col("runs").isNull(), F.col("text"))
                    .otherwise(F.array_join(rest, " ")).alias("text")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      sha256_hex(F.array_join(items, ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n,
              unnest(list_transform(range(0, len(ws) - least(len(ws), 10) + 1),
                     lambda i: array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' '))) AS win
       FROM b WHERE len(ws) > 0),
dw AS (SELECT doc_id, n, unnest(range(0, len(ws) - n + 1)) AS pos,
              unnest(list_transform(range(0, len(ws) - n + 1), lambda i: array_to_string(ws[i + 1 : i + n], ' '))) AS win
       FROM t, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
h AS (SELECT DISTINCT doc_id, item_id, pos, n FROM dw JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
