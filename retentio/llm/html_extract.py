"""Main text of web pages by consensus host paths.

A page is read as a tree of elements.  Every text block belongs to the
containers around it; a container is known by its generalised path - tags with
their sorted classes from the body down, digits in class names as ``#`` - and
all elements of one path count together.  A path's score is the text in it that
is neither boilerplate nor link text - less with each container between -, times
the share which that is of all its text; elements that say they hold the main
content weigh double.

Each page votes for its best path, Spark counts the votes per host, and the
paths with at least ``LEAST_SHARE`` of a host's votes are the host's winning
paths.  Then every page is extracted again: of the winning paths that have text
in it, the one with most votes; the page's own best path only where there is
none.  A long comment thread or a short article thus does not mislead a single
page.

Blocks inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments (told by tag, role, or class and id words)
are no part of the text.  White space inside a block is one space, blocks are
joined in page order by a newline, nothing is capped.

Votes are pre-aggregated.  Hosts with more than 1/``HOT`` of all pages are at
most ``HOT``, so their winning paths are broadcast and their pages never
shuffled by host; the pages of the others are joined on the host.

Defined cases: null or empty html gives the empty text; a page without host
(null or odd url) is extracted by its own best path; repeated rows vote and are
extracted each; null ids and urls stay null; html may be cut off anywhere; a
page without text outside boilerplate gets the empty text; extra columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import collections
import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, load

#: Share of a host's votes, in percent, that makes a winning path: at most 20 paths a host.
LEAST_SHARE = 5
#: A host with more than 1/HOT of all pages is hot; so there are at most HOT of them.
HOT = 10_000
#: Longer paths are known by their hash.
LONG_PATH = 240
LINK_WEIGHT = 0.1
#: What text counts for the container above its own, and again for the next.
UPWARD = 0.7

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|xmp|noembed|noframes)\b(?P<rawattrs>(?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)"
    r"(?:>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark nobr q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr").split())
#: Elements that can be the article.
CONTAINER = frozenset("body div section article main td center".split())
#: Elements whose content is never text of the article.
LEFT_OUT = frozenset("nav footer aside form button select noscript template svg canvas object audio video dialog menu head datalist".split())
#: A start tag closes an open element of these.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
#: End tags that reach beyond open containers.
STRONG = CONTAINER | LEFT_OUT | frozenset("header table ul ol tr blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = frozenset("article articlebody main content entry post story maincontent postcontent entrycontent".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of class and id names that mark boilerplate wherever they stand in the name.
BOILERPLATE_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars sidenav topbar toolbar masthead "
    "footer footers cookie cookies consent gdpr notice notices newsletter subscribe subscription signup paywall popup modal overlay "
    "share sharing social sharebar related recommended recommendations comment comments commentlist disqus discussion replies reply "
    "respond responses login search searchbox pagination pager skip skiplink copyright").split())
#: Words that say an element only stands beside, or is laid out for, what the name tells.
NEGATED = frozenset("has with no without is not".split())
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_words(names: str) -> list[list[str]]:
    """Words of each name, digits left out."""
    return [[w.lower() for w in NAME_PARTS.findall(n)] for n in names.split()]


def is_boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    if tag in LEFT_OUT:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    if "style" in attributes and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"], re.I):
        return True
    if tag in ("body", "html", "main"):
        return False
    for words in name_words(f"{attributes.get('class', '')} {attributes.get('id', '')}"):
        # 'sidebar-content' and 'sideBar' are sidebars, 'content-with-sidebar' is not
        told = BOILERPLATE_WORDS.intersection(words) or "".join(words) in BOILERPLATE_WORDS
        if told and not NEGATED.intersection(words):
            return True
    return False


def says_main(tag: str, attributes: dict[str, str]) -> bool:
    return (tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
            or attributes.get("itemprop", "").lower() == "articlebody"
            or any(MAIN_WORDS.intersection((*w[-1:], "".join(w))) for w in name_words(attributes.get("class", ""))))


def step(tag: str, attributes: dict[str, str]) -> str:
    """A path's step: the tag and its sorted classes, digits generalised."""
    classes = attributes.get("class")
    if not classes:
        return tag
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})])


class Node:
    """An open element: path of the nearest container, whether it is left out and whether its block is,
    whether its text is link text, and whether it lies in an article and in that article's own header."""

    __slots__ = ("tag", "path", "left_out", "block_out", "link", "article", "own_header")

    def __init__(self, tag, path, left_out=False, block_out=False, link=False, article=False, own_header=False):
        self.tag, self.path, self.left_out, self.block_out, self.link = tag, path, left_out, block_out, link
        self.article, self.own_header = article, own_header


class Page:
    """Blocks of a page in order, each with its container's path, and whether paths say that they are main."""

    def __init__(self, source: str):
        self.parents: dict[str, str | None] = {"body": None}
        self.main: set[str] = set()
        #: (path, text, length of link text, boilerplate)
        self.blocks: list[tuple[str, str, int, bool]] = []
        self.stack = [Node("body", "body")]
        self.opened: collections.Counter = collections.Counter()
        self.pieces: list[str] = []
        self.links: list[str] = []
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.text(source[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"]:
                    self.block_ends()
                continue
            tag = tag.lower()
            if m["end"]:
                self.close(tag)
            else:
                self.open(tag, m["attrs"])
        if at < len(source):
            self.text(source[at:])
        self.block_ends()

    def text(self, raw: str):
        top = self.stack[-1]
        if top.left_out and not top.block_out:  # an inline part is left out of its block
            return
        if "&" in raw:
            raw = html.unescape(raw)
        self.pieces.append(raw)
        if top.link:
            self.links.append(raw)

    def block_ends(self):
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                top = self.stack[-1]
                linked = len(" ".join("".join(self.links).split())) if self.links else 0
                self.blocks.append((top.path, text, min(linked, len(text)), top.block_out))
            self.pieces.clear()
        self.links.clear()

    def leave(self, upto: int):
        """Close the open elements from the top down to the ``upto``-th."""
        if any(n.tag not in INLINE for n in self.stack[upto:]):
            self.block_ends()
        self.opened.subtract(n.tag for n in self.stack[upto:])
        del self.stack[upto:]

    def close(self, tag: str):
        if tag in ("html", "body"):
            return
        inline = tag in INLINE
        if self.opened[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                above = self.stack[i].tag
                if above == tag:
                    self.leave(i)
                    return
                # a stray end tag does not reach beyond what holds it
                if above not in INLINE and (inline or above in CONTAINER and tag not in STRONG):
                    break
        if not inline:
            self.block_ends()

    def open(self, tag: str, attrs: str):
        if tag == "br":
            self.pieces.append(" ")
            return
        block = tag not in INLINE
        if block:
            self.block_ends()
            self.imply_ends(tag)
        if tag in VOID or tag in ("html", "body"):
            return
        attributes = {}
        if attrs and not attrs.isspace():
            attributes = {n.lower(): html.unescape(a or b or c) for n, a, b, c in ATTRIBUTE.findall(attrs)}
        top = self.stack[-1]
        left_out = is_boilerplate(tag, attributes)
        own_header = not left_out and (top.own_header or tag == "header" and top.article and not top.left_out)
        # an article's own header keeps its headings, no other header does
        left_out = left_out or tag == "header" or top.left_out and not (own_header and tag in HEADINGS)
        if not block:
            if tag == "a":
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].tag not in INLINE:
                        break
                    if self.stack[i].tag == "a":
                        self.leave(i)
                        break
            elif left_out == top.left_out:
                return
        path = top.path
        if tag in CONTAINER:
            path = f"{path}/{step(tag, attributes)}"
            if len(path) > LONG_PATH:
                path = "~" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            self.parents.setdefault(path, top.path)
            if says_main(tag, attributes):
                self.main.add(path)
        self.stack.append(Node(tag, path, left_out, left_out if block else top.block_out, tag == "a" or top.link and not block,
                               top.article or tag in ("article", "main"), own_header))
        self.opened[tag] += 1

    def imply_ends(self, tag: str):
        """End tags that this block's start implies: of a paragraph, and of an element of its own kind."""
        closes = CLOSES.get(tag, ())
        for i in range(len(self.stack) - 1, 0, -1):
            above = self.stack[i].tag
            if above == "p" or above in closes or above in HEADINGS and tag in HEADINGS:
                self.opened.subtract(n.tag for n in self.stack[i:])
                del self.stack[i:]
            elif above not in INLINE:
                break

    def scores(self) -> dict[str, float]:
        """Score of each container path with text outside boilerplate."""
        good, felt = dict.fromkeys(self.parents, 0.0), dict.fromkeys(self.parents, 0.0)
        every = dict.fromkeys(self.parents, 0)
        for path, text, linked, left_out in self.blocks:
            if not left_out:
                good[path] += len(text) - linked + LINK_WEIGHT * linked
            every[path] += len(text)
        felt.update(good)
        # paths stand behind their parents
        for path, parent in reversed(self.parents.items()):
            if parent is not None:
                good[parent] += good[path]
                felt[parent] += UPWARD * felt[path]
                every[parent] += every[path]
        return {p: felt[p] * (g / every[p]) * (2.0 if p in self.main else 1.0) for p, g in good.items() if g > 0}

    def extract(self, path: str | None) -> str:
        """Text of all elements of the path."""
        held = {None: False}
        for p, parent in self.parents.items():
            held[p] = p == path or held[parent]
        return "\n".join(text for p, text, _, left_out in self.blocks if held[p] and not left_out)


def best_path(page: Page, votes: dict[str, int] | None = None) -> str | None:
    """The page's best path: of those voted for that have text in it the one with most votes, else that with
    the highest score.  Ties: the higher score, the deeper, then the smaller path."""
    scores, votes = page.scores(), votes or {}
    depth = {None: 0}
    for p, parent in page.parents.items():
        depth[p] = depth[parent] + 1
    return min(scores, key=lambda p: (-votes.get(p, 0), -scores[p], -depth[p], p)) if scores else None


def host_of(url) -> F.Column:
    """Lower-case host of a url column; null where there is none."""
    host = F.lower(F.regexp_extract(url.cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): pages of a host whose best path this is."""
    def run(batches):
        for batch in batches:
            seen: collections.Counter = collections.Counter()
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html")):
                path = best_path(Page(source.as_py()))
                if path is not None:
                    seen[host, path] += 1
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([k[0] for k in seen], pa.string()), "path": pa.array([k[1] for k in seen], pa.string()),
                "votes": pa.array(list(seen.values()), pa.int64())})

    return (pages.where("host IS NOT NULL").select("host", "html").mapInArrow(run, "host string, path string, votes long")
            .groupBy("host", "path").agg(F.sum("votes").alias("votes")))


def host_paths(votes: DataFrame) -> DataFrame:
    """(host, n, paths): a host's votes, and its winning paths as (votes, path), most votes first."""
    per_host = votes.groupBy("host").agg(F.sum("votes").alias("n"))
    won = votes.join(per_host, "host").where(F.col("votes") * 100 >= F.col("n") * LEAST_SHARE)
    return won.groupBy("host").agg(F.first("n").alias("n"), F.sort_array(
        F.collect_list(F.struct("votes", "path")), asc=False).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, path (that of the container taken, null if none),
    by_host (whether it is one of the host's winning paths)."""
    scratch = Scratch(pages.sparkSession, "html")
    clean = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"),
                         host_of(pages["url"]).alias("host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    winners = scratch.table(host_paths(scratch.table(page_votes(clean))))
    total = winners.agg(F.sum("n")).first()[0] or 0
    hot = winners.where(F.col("n") * HOT > total)
    cold = winners.where(F.col("n") * HOT <= total)
    # at most HOT rows of at most 100 / LEAST_SHARE paths
    dealt = clean.join(F.broadcast(hot.select("host", F.col("paths").alias("hot_paths"))), "host", "left")
    if not cold.isEmpty():
        rest = dealt.where("hot_paths IS NULL").drop("hot_paths")
        dealt = dealt.where("hot_paths IS NOT NULL").withColumnRenamed("hot_paths", "paths").unionByName(
            rest.join(cold.select("host", "paths"), "host", "left"))
    else:
        dealt = dealt.withColumnRenamed("hot_paths", "paths")
    id_type = pages.schema["page_id"].dataType.simpleString()
    url_type = pages.schema["url"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, paths, by_host = [], [], []
            for source, won in zip(batch.column("html"), batch.column("paths")):
                page = Page(source.as_py())
                votes = {w["path"]: w["votes"] for w in won.as_py() or ()}
                path = best_path(page, votes)
                texts.append(page.extract(path).encode("utf-8", "replace").decode())
                paths.append(path)
                by_host.append(path in votes)
            text = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), text, pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(paths, pa.string()), pa.array(by_host, pa.bool_())],
                names=["page_id", "url", "text", "n_chars", "path", "by_host"])

    return dealt.select("page_id", "url", "html", "paths").mapInArrow(
        run, f"page_id {id_type}, url {url_type}, text string, n_chars long, path string, by_host boolean")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages"))
