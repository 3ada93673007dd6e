"""Temporal URL filter (native).

Dated entries (pattern, action, day) of a list become disjoint validity
intervals: entries of one pattern that repeat the action before them add
nothing, an ``add`` opens an interval and the next ``remove`` closes it.  A
capture asks for its host, the host's parent domains and its path prefixes; an
as-of join keeps the intervals that hold at its fetch time.  Intervals are cut
at periods of ``PERIOD`` days and joined on (pattern, period), so a pattern
with a long history meets only the part of it around the capture; an interval
has a piece in each period that has captures, and one that no entry closes
holds for all days from its first on.

Defined cases: an entry without pattern, action or day is no entry; of several
entries of one pattern on one day, ``remove`` wins; a capture with a null or
unreadable url, or without a fetch day, is not blocked; repeated captures are
each answered; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.llm.common import load

PERIOD = 32
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[^:]+://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def patterns(url: Column) -> Column:
    """The list patterns that cover ``url``: 'host' and each parent domain of two labels or more,
    and 'host/dir/' for each directory of the path."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.split(F.regexp_extract(url, PATH, 1), "/", -1)
    depth = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))),
                           lambda i: F.concat(h, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(h != "", F.array_distinct(F.concat(domains, F.when(depth > 1, prefixes).otherwise(
        F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until): days [since, until) on which the pattern is listed; disjoint.
    ``until`` is null where no entry closes the interval."""
    per_day = (entries.where("pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
               .groupBy("pattern", "day").agg(F.max("action").alias("action")))
    by_day = Window.partitionBy("pattern").orderBy("day")
    turns = per_day.withColumn("before", F.lag("action").over(by_day)).where(
        "before IS NULL AND action = 'add' OR before != action")
    # after the turns only, add and remove alternate
    return (turns.withColumn("until", F.lead("day").over(by_day)).where("action = 'add'")
            .select("pattern", F.col("day").alias("since"), "until"))


def as_of(captures: DataFrame, listed: DataFrame, period: int = PERIOD) -> DataFrame:
    """The rows of ``captures`` (url, day and any others) with ``blocked``, ``pattern`` (of the entries
    in force the longest pattern, then the first) and ``listed_since``."""
    asked = captures.select(F.struct(*[captures[c] for c in captures.columns]).alias("row"),
                            captures["url"].alias("url"), captures["day"].alias("day"))
    # one row: the periods that have captures
    used = asked.agg(F.collect_set(F.floor(F.col("day") / period)).alias("used"))
    pieces = listed.crossJoin(F.broadcast(used)).withColumn("period", F.explode(F.filter("used", lambda p: (
        p >= F.floor(F.col("since") / period)) & (F.col("until").isNull() | (p <= F.floor((F.col("until") - 1) / period)))))).drop("used")
    # equal (url, day) ask once: a url that is captured very often is one row here
    distinct = asked.select("url", "day").where("url IS NOT NULL AND day IS NOT NULL").distinct()
    keys = distinct.select("url", "day", F.floor(F.col("day") / period).alias("period"),
                           F.explode(patterns(F.col("url"))).alias("pattern"))
    held = keys.join(pieces, ["pattern", "period"]).where("since <= day AND (until IS NULL OR day < until)")
    best = (held.groupBy("url", "day").agg(F.min(F.struct(
        (-F.length("pattern")).alias("n"), F.col("pattern"), F.col("since"))).alias("best")))
    return (asked.join(best, ["url", "day"], "left")
            .select("row", F.col("best").isNotNull().alias("blocked"), F.col("best.pattern").alias("pattern"),
                    F.col("best.since").alias("listed_since")))


def day_of(page_id: Column) -> Column:
    """Fetch day of a page of the test tables: pages are fetched over two years, in no order."""
    return F.pmod(page_id * 7919 + 17, F.lit(730)).cast("int")


def reports(pages: DataFrame) -> DataFrame:
    """List entries derived from the pages: each page whose id's md5 starts with 0 to 3 reports its
    host's domain, its host or its first directory on its fetch day plus one; each that starts with
    f withdraws it."""
    h = F.md5(F.col("page_id").cast("string"))
    c = patterns(F.col("url"))
    which = F.conv(F.substring(h, 2, 1), 16, 10).cast("int")
    return (pages.select("page_id", h.alias("h"), c.alias("c"), which.alias("w"), (day_of(F.col("page_id")) + 1).alias("day"))
            .where((F.size("c") > 0) & F.substring("h", 1, 1).isin("0", "1", "2", "3", "f"))
            .select(F.element_at("c", F.pmod("w", F.size("c")).cast("int") + 1).alias("pattern"),
                    F.when(F.substring("h", 1, 1) == "f", "remove").otherwise("add").alias("action"), "day"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select("page_id", "url", day_of(F.col("page_id")).alias("day"))
    out = as_of(captures, intervals(reports(pages)))
    return out.select("row.page_id", "row.day", "blocked", "pattern", "listed_since")


ORACLE = r"""
WITH p AS (SELECT page_id, url, CAST(((page_id * 7919 + 17) % 730 + 730) % 730 AS INT) AS day,
                  rtrim(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS h,
                  regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
k AS (SELECT *, string_split(h, '.') AS l, string_split(path, '/') AS s FROM p),
c AS (SELECT page_id, url, day, CASE WHEN h <> '' THEN list_concat(
             list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.')),
             CASE WHEN len(s) > 1 THEN list_transform(range(1, len(s)), lambda i: h || array_to_string(s[1:i], '/') || '/')
                  ELSE [] END) ELSE [] END AS c FROM k),
e AS (SELECT c[CAST(('0x' || substr(md5(page_id::VARCHAR), 2, 1))::INT % len(c) AS INT) + 1] AS pattern, day + 1 AS day,
             max(CASE WHEN substr(md5(page_id::VARCHAR), 1, 1) = 'f' THEN 'remove' ELSE 'add' END) AS action
      FROM c WHERE len(c) > 0 AND substr(md5(page_id::VARCHAR), 1, 1) IN ('0', '1', '2', '3', 'f') GROUP BY 1, 2),
q AS (SELECT DISTINCT page_id, day, unnest(c) AS pattern FROM c),
a AS (SELECT q.page_id, q.pattern, e.day AS entry_day, e.action FROM q ASOF JOIN e ON q.pattern = e.pattern AND q.day >= e.day),
since AS (SELECT a.page_id, a.pattern,
                 (SELECT min(x.day) FROM e x WHERE x.pattern = a.pattern AND x.action = 'add' AND x.day <= a.entry_day
                  AND x.day > coalesce((SELECT max(y.day) FROM e y WHERE y.pattern = a.pattern AND y.action = 'remove' AND y.day <= a.entry_day), -1)) AS since
          FROM a WHERE a.action = 'add'),
b AS (SELECT page_id, pattern, since, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern) AS r FROM since)
SELECT p.page_id, p.day, b.pattern IS NOT NULL AS blocked, b.pattern, b.since AS listed_since
FROM p LEFT JOIN b ON p.page_id = b.page_id AND b.r = 1
"""
