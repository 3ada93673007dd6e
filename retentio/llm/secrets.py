"""Secret scans with multipart credential linking (native).

Three kinds of strong finds are reported wherever they stand: ``assign``,
``access`` and ``hex``.  Three kinds of weak candidates - ``ident`` (an access
identifier), ``key`` (a possible secret) and ``endpoint`` - are reported only
with a complementary part near by: an identifier with a secret, a secret with
an identifier or an endpoint, an endpoint with both.  Near means in the same
scope (no blank line between) with starts at most ``REACH`` characters apart,
where a part, or parts that overlap, count as ``PART`` characters at most: a long
secret does not keep what stands around it apart.

Finds are cut out with split and regexp_extract_all, which agree on the
leftmost non-overlapping matches, so positions are running sums of lengths.
The linking is an interval join: starts, so counted, fall into bins of ``REACH``
characters, each bin keeps the smallest and largest start of each part, and a
candidate asks its own bin and the two beside it.  Nothing pairs parts with
parts, so a text full of candidates costs no more than their number.

Defined cases: null or empty text has no finds; rows equal in doc_id and text
share one result; a weak candidate that overlaps a strong find is left out;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, load, running_sums, sha256_hex, with_key

REACH = 256
#: Characters that a part counts for in distances, at most.
PART = 64
KEY = ["d", "t"]
#: kind -> (pattern, group that is measured, its least length, what a text must hold at all); matches
#: that fail are dropped.  A run of capitals or hex digits that is long enough is the same match
#: whether the length is asked inside the pattern or after it; an assignment is not.
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "[:=]"),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
}
WEAK = {
    "ident": (r"""(?<![A-Za-z0-9_])(?:(?i:access_?key(?:_?id)?|client_?id|key_?id|user(?:_?name)?|login|account)"""
              r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}|[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]+)""", 0, 1, "[:=@]"),
    "key": (r"""(?<![A-Za-z0-9_])(?:(?i:pwd|pass|passphrase|auth|bearer|credentials?|private_?key|signature)"""
            r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|(?=[A-Za-z0-9+/]{0,38}[a-z])(?=[A-Za-z0-9+/]{0,38}[A-Z])"""
            r"""(?=[A-Za-z0-9+/]{0,38}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/]))""", 0, 1, "[:=]|[A-Za-z0-9+/]{40}"),
    "endpoint": (r"""(?<![A-Za-z0-9_])(?:[a-z][a-z0-9+.-]{1,16}://[^\s"'<>]{3,}|(?i:host|endpoint|server)"""
                 r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5})""", 0, 1, "[:=]"),
}
KINDS = [*STRONG, *WEAK]
#: The part that a kind plays.
IDENT, SECRET, ENDPOINT = ("access", "ident"), ("assign", "hex", "key"), ("endpoint",)
BREAK = r"\n[ \t\r]*\n\s*"
SPAN = "array<struct<from:bigint,kind:int,to:bigint>>"


def places(text: Column, pattern: str) -> Column:
    """[from, to) of each leftmost non-overlapping match, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("long"))
    own = F.transform(found, lambda s: F.length(s).cast("long"))
    ends = running_sums(F.zip_with(F.slice(between, F.lit(1), F.size(own)), own, lambda a, b: a + b))
    return F.zip_with(ends, own, lambda e, n: F.struct((e - n).alias("from"), e.alias("to")))


def finds(text: Column, kind: str, pattern: str, group: int, least: int, needs: str) -> Column:
    """Spans of one kind; a text that lacks what every match holds is not searched further."""
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s: F.length(s))
    spans = F.filter(F.arrays_zip(places(text, pattern).alias("p"), measured.alias("n")), lambda x: x["n"] >= least)
    out = F.transform(spans, lambda x: F.struct(
        x["p"]["from"].alias("from"), F.lit(KINDS.index(kind)).alias("kind"), x["p"]["to"].alias("to")))
    return F.when(text.rlike(needs) & text.rlike(pattern), out).otherwise(F.array().cast(SPAN))


def all_finds(docs: DataFrame) -> DataFrame:
    """(doc_id, d, t, assign, access, hex, base, weak, breaks): spans of the strong kinds, all of
    them in order, the weak candidates clear of them, and where blank lines end scopes."""
    out = docs.select("doc_id", *KEY, "text", *[finds(F.col("text"), k, *v).alias(k) for k, v in STRONG.items()],
                      *[finds(F.col("text"), k, *v).alias(f"_{k}") for k, v in WEAK.items()])
    base = F.array_sort(F.concat(*STRONG))
    weak = F.concat(*[f"_{k}" for k in WEAK])
    out = out.select("doc_id", *KEY, "text", *STRONG, base.alias("base"), weak.alias("weak"))
    clear = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["from"] < w["to"]) & (w["from"] < b["to"])))
    breaks = F.when(F.size("weak") > 0, F.transform(places(F.col("text"), BREAK), lambda p: p["to"]))
    return out.select("doc_id", *KEY, *STRONG, "base", F.when(F.size("weak") > 0, clear).otherwise(F.col("weak")).alias("weak"),
                      F.coalesce(breaks, F.array().cast("array<bigint>")).alias("breaks"))


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(d, t, linked): the weak candidates of a document that have their complementary parts near."""
    index = {k: i for i, k in enumerate(KINDS)}
    scope_end = F.lit(-1)
    rows = (found.where(F.size("weak") > 0).select(*KEY, F.explode(F.concat(
        "base", "weak", F.transform("breaks", lambda b: F.struct(
            b.alias("from"), scope_end.alias("kind"), b.alias("to"))))).alias("x")).select(*KEY, "x.*").distinct())
    # a scope's number is how many blank lines end at or before its parts
    by_doc = Window.partitionBy(*KEY).orderBy("from", "kind")
    parts = rows.withColumn("scope", F.sum((F.col("kind") < 0).cast("int")).over(by_doc))
    # blocks of overlapping parts; what a block has over PART characters is left out of places
    parts = parts.withColumn("seen", F.coalesce(F.max("to").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumn("block", F.max(F.when(F.col("from") >= F.col("seen"), F.col("from"))).over(by_doc))
    parts = parts.withColumn("last", F.lag("block").over(by_doc))
    over = F.when(F.col("block") == F.col("last"), F.lit(0)).otherwise(
        F.coalesce(F.greatest(F.col("seen") - F.col("last") - PART, F.lit(0)), F.lit(0)))
    place = F.col("from") - F.col("over") - F.greatest(F.col("from") - F.col("block") - PART, F.lit(0))
    parts = (parts.withColumn("over", F.sum(over).over(by_doc)).where("kind >= 0").withColumn("at", place)
             .withColumn("bin", F.floor(F.col("at") / reach)).select(*KEY, "scope", "from", "kind", "to", "at", "bin"))

    def ends(kinds, name):
        at = F.when(F.col("kind").isin([index[k] for k in kinds]), F.col("at"))
        return [F.min(at).alias(f"{name}_lo"), F.max(at).alias(f"{name}_hi")]

    bins = parts.groupBy(*KEY, "scope", "bin").agg(
        *ends(IDENT, "i"), *ends(SECRET, "s"), *ends(ENDPOINT, "e"))
    asks = (parts.where(F.col("kind").isin([index[k] for k in WEAK]))
            .withColumnRenamed("bin", "own").withColumn("bin", F.explode(F.array(F.col("own") - 1, "own", F.col("own") + 1))))
    met = asks.join(bins, [*KEY, "scope", "bin"])

    def near(name):
        # the whole own bin is within reach; of the others, what lies nearest decides
        return F.max(F.coalesce(F.when(F.col("bin") == F.col("own"), F.col(f"{name}_lo").isNotNull())
                                .when(F.col("bin") < F.col("own"), F.col(f"{name}_hi") >= F.col("at") - reach)
                                .otherwise(F.col(f"{name}_lo") <= F.col("at") + reach), F.lit(False))).alias(name)

    sides = met.groupBy(*KEY, "from", "kind", "to").agg(near("i"), near("s"), near("e"))
    kind = F.col("kind")
    ok = (F.when(kind == index["ident"], F.col("s")).when(kind == index["key"], F.col("i") | F.col("e"))
          .otherwise(F.col("i") & F.col("s")))
    return sides.where(ok).groupBy(*KEY).agg(F.collect_set(F.struct("from", "kind", "to")).alias("linked"))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, the spans of each strong kind, ``base`` and ``spans`` (base and
    linked candidates), in the order of start and kind."""
    found = all_finds(with_key(docs))
    slim = found.select("doc_id", *KEY, *[F.size(k).cast("long").alias(f"n_{k}") for k in STRONG], "base", "weak", "breaks")
    slim = Scratch(docs.sparkSession, "secrets").table(slim)
    out = slim.drop("weak", "breaks").join(linked(slim, reach), KEY, "left")
    extra = F.coalesce("linked", F.array().cast(SPAN))
    return out.select("doc_id", *[f"n_{k}" for k in STRONG], "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["from"].cast("string"), x["to"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(load(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in STRONG], sha256_hex(written("base")).alias("base_sha256"),
                      written("spans").alias("spans"))
