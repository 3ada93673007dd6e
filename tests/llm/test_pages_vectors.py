"""HTML extraction, centroid clustering and hard negatives against plain Python."""

import hashlib
import math
import random
import time

import numpy as np
import pytest

from retentio.llm import centroids, hard_negatives, html_extract
from retentio.llm.html_extract import Page, best_path, extract_pages
from tests.llm.cases import prose, rows_of

CLASHING = "host paths path html2 votes n x label2 cluster distance _r _a slot score rank best limits d t row".split()


def with_extra(df):
    for i, c in enumerate(CLASHING):
        df = df.selectExpr("*", f"{i} AS `{c}`")
    return df


# --- html ---------------------------------------------------------------------------------------

def text_of(source, path=None):
    page = Page(source)
    return page.extract(path or best_path(page))


@pytest.mark.parametrize("source, text", [
    ("", ""), ("   \n", ""), ("plain", "plain"),
    ("<p>one\n  two\t<b>th</b>ree<br>four<p>five", "one two three four\nfive"),
    ("a &lt;b&gt; &amp; &eacute;&#233;&#x1F600; &amp", "a <b> & éé😀 &"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1\n2\n3"),
    ("1 < 2 and <3", "1 < 2 and <3"), ("x</div></p></b>y", "x\ny"),
    ("<p title='it's > x'>q", "x'>q"), ("<p title=\"a > b\">q", "q"),
    ("<script>if (a < b) { '<p>' }</script>t<style>p{}</style><!-- c > --><textarea>w</textarea>", "t"),
    ("t<script>never closed <p>", "t"), ("t<!-- never closed <p>", "t"), ("t<p class=\"cut off", "t"),
    ("<nav>m</nav><div class=ad>a</div><form>f</form><footer>&copy;</footer><aside>s</aside><p>t", "t"),
    ("<p>a <span class='ad'>buy</span> b</p>", "a b"),
    ("<div hidden>h</div><div style='display: none'>h</div><div role=navigation>h</div>t", "t"),
    ("<div id=sideBar>s</div><div class='cookie-notice'>c</div><div class='has-sidebar'>t</div>", "t"),
    ("<header>site</header><article><header><h1>T</h1><p>by me</p></header><p>text</p></article>", "T\ntext"),
    ("<article><p>text</p><section class='comments'><article class='comment'><p>a comment that is longer</p></article>"
     "</section></article>", "text"),
    ("<div class='menu'>only</div>", ""), ("<article><a href=x>all of it a link</a></article>", "all of it a link"),
    ("<a href=1>one<a href=2>two</article>three", "onetwo\nthree"),
])
def test_text_of_one_page(source, text):
    assert text_of(source) == text


def test_long_and_deep_pages_take_linear_time():
    t0 = time.time()
    for source in ("<div>" * 20000 + "<p>t " * 50000, "<blockquote>" * 20000 + "</span><p>t</p>" * 50000, "<a href=x>" * 100000 + "t",
                   "<" * 300000, "<!--" * 100000, "<p a='" * 100000, "<nav><h1>" * 30000, "&" * 300000, "x" * 3_000_000,
                   "<div class=a>" * 5000 + "</section>" * 50000 + "t"):
        page = Page(source)
        page.extract(best_path(page))
    assert time.time() - t0 < 60


def page_of(main, comment="", shape="x-{n}", n=0):
    body = f"<div class='{shape.format(n=n)}'><p>{main}</p></div>"
    return (f"<html><head><title>t</title></head><body><div class='x1'><a href=/>home</a></div>{body}"
            f"<div class='below'><p>{comment}</p></div></body></html>")


def test_a_hosts_votes_decide(spark):
    rows = [(i, f"http://a.example/{i}", page_of(prose(i, 60), prose(50 + i, 10), n=i)) for i in range(12)]
    # a short article over a long thread, and one without text in the article
    rows += [(20, "http://A.example:80/20", page_of("tiny", prose(70, 200), n=3)), (21, "//a.example/21?x", page_of("", prose(71, 50)))]
    # a second layout of the host, an own host with the opposite layout, no host
    rows += [(30 + i, f"https://u@a.example/{i}", f"<main><p>{prose(200 + i, 50)}</p></main><p>foot</p>") for i in range(3)]
    rows += [(40, "http://b.example/", page_of("tiny", prose(72, 200))), (41, None, page_of("tiny", prose(72, 200))),
             (42, "no url", None), (None, None, "<p>x"), (43, "http://c.example", ""), (44, "http://c.example", "<p>k"),
             (44, "http://c.example", "<p>k")]
    out = {}
    for r in extract_pages(with_extra(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect():
        out.setdefault(r["page_id"], []).append(r)
    flat = lambda s: " ".join(s.split())
    for i in range(12):
        assert out[i][0]["text"] == flat(prose(i, 60)) and out[i][0]["path"] == "body/div.x-#" and out[i][0]["by_host"]
    assert out[20][0]["text"] == "tiny" and out[20][0]["n_chars"] == 4
    assert out[21][0]["text"] == flat(prose(71, 50)) and out[21][0]["path"] == "body/div.below"
    for i in range(3):
        assert out[30 + i][0]["text"] == flat(prose(200 + i, 50))
    for i in (40, 41):
        assert flat(prose(72, 200)) in out[i][0]["text"]
    assert out[41][0]["by_host"] is False and out[41][0]["url"] is None
    assert out[42][0]["text"] == "" and out[42][0]["path"] is None and out[None][0]["text"] == "x"
    assert out[43][0]["text"] == "" and [r["text"] for r in out[44]] == ["k", "k"]


@pytest.mark.parametrize("hot", [1, 10_000])
def test_hot_and_cold_hosts_give_the_same(spark, monkeypatch, hot):
    monkeypatch.setattr(html_extract, "HOT", hot)
    rows = [(i, f"http://h{i % 4 if i % 3 else 0}.example/", page_of(prose(i, 40), prose(i, 1 + i % 90), n=i)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    votes = {}
    for _, url, source in rows:
        path = best_path(Page(source))
        votes.setdefault(url, {}).setdefault(path, 0)
        votes[url][path] += 1
    expected = []
    for i, url, source in rows:
        won = {p: n for p, n in votes[url].items() if 100 * n >= html_extract.LEAST_SHARE * sum(votes[url].values())}
        page = Page(source)
        text = page.extract(best_path(page, won))
        expected.append((i, url, text, len(text)))
    assert rows_of(extract_pages(pages).select("page_id", "url", "text", "n_chars")) == sorted(expected, key=repr)


def test_no_pages(spark):
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# --- centroids ----------------------------------------------------------------------------------

def kept(rows, dim, scale):
    out = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(scale * x) <= centroids.LIMIT for x in v):
            out.append((i, tuple(math.floor(scale * x) for x in v)))
    return out


def cluster_brute(rows, dim, scale, k, rounds):
    vectors = kept(rows, dim, scale)
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    cents = [v for _, v in seeds[:k]]
    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds if cents else 0):
        groups = {}
        for _, v in vectors:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            cents[j] = tuple(sum(c) // len(g) for c in zip(*g))
    at = [(i, *near(v)) for i, v in vectors] if cents else []
    sums = {}
    for _, d, j in at:
        sums[j] = sums.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha[j]) for i, d, j in at), key=repr)


def vectors_of(seed, n, dim, spread=1.0):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(middle)]) for i in range(n)]


def test_search_is_exact_on_ties_and_large_numbers():
    r = np.random.default_rng(5)
    for size, k, d in ((3, 9, 2), (40, 30, 6), (1 << 23, 8, 4), (1 << 27, 8, 64)):
        rows = r.integers(-size, size, (200, d), endpoint=True)
        cents = [list(map(int, c)) for c in r.integers(-size, size, (k, d), endpoint=True)]
        cents += [cents[0], cents[1][::-1]]  # an equal one, and one of the same sum
        at, dist = centroids.Codebook(cents).nearest(rows)
        for v, j, q in zip(rows.tolist(), at, dist):
            assert (int(q), int(j)) == min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))


def test_clustering(spark):
    odd = [(500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan")] * 4),
           (505, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.0, 0.0]), (506, [1e300, 0.0, 0.0, 0.0]), (507, [3e5] * 4),
           (1, [9.0, 9.0, 9.0, 9.0]), (1, [9.0, 9.0, 9.0, 9.0])]
    rows = vectors_of(2, 120, 4, 0.2) + odd
    got = centroids.cluster_vectors(with_extra(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), 7, 3, 4, 64)
    assert rows_of(got.drop("centroid")) == cluster_brute(rows, 4, 64, 7, 3)
    for r in got.collect():
        assert hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest() == r["centroid_sha256"]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [0.0, 0.0])], [(3, [0.1, 0.2]), (4, [0.1, 0.2])]])
def test_clustering_of_few(spark, rows):
    got = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 16, 3, 2, 64)
    brute = cluster_brute([(i, v and [float(np.float32(x)) for x in v]) for i, v in rows], 2, 64, 16, 3)
    assert rows_of(got.drop("centroid")) == brute


# --- hard negatives -----------------------------------------------------------------------------

def mine_brute(rows, every, k_pos, k_neg, scale=256):
    own = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(
                x is None or not math.isfinite(x) or abs(x * scale) > hard_negatives.LIMIT for x in v):
            continue
        one = (label, [math.floor(scale * x) for x in v])
        own[i] = min(own.get(i, one), one)
    out = []
    for a, (la, va) in own.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in own.items() if i != a)
        for p, pid, _ in [s for s in scored if s[2] == la][:k_pos]:
            fit = [s for s in scored if s[2] != la and 80 * -p <= 100 * -s[0] <= 100 * -p][:k_neg]
            out += [(a, pid, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fit)]
    return sorted(out, key=repr)


def labelled(seed, n, dim, labels, grain):
    r = random.Random(seed)
    return [(i, [round(r.gauss(0.3, 0.5) * grain) / grain for _ in range(dim)], int(r.random() ** 2 * labels)) for i in range(n)]


@pytest.mark.parametrize("grain, anchors, block", [(2, 2048, 32768), (1000, 3, 20)])
def test_hard_negatives(spark, monkeypatch, grain, anchors, block):
    """Coarse vectors tie often; small blocks put an anchor's rows into many groups."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    monkeypatch.setattr(hard_negatives, "TILE", 16)
    rows = labelled(grain, 250, 5, 4, grain)
    rows += [(900, None, 1), (901, [1.0] * 5, None), (None, [1.0] * 5, 1), (902, [float("nan")] * 5, 1), (903, [1.0, None, 0.0, 0.0, 0.0], 1),
             (904, [float("inf")] * 5, 2), (910, [1.0] * 3, 1), (911, [1.0] * 7, 2), (920, [], 1), (930, [0.5] * 5, 3), (930, [0.5] * 5, 3),
             (940, [-1.0] * 5, 3), (950, [0.4] * 5, 99), (960, [1e300] * 5, 1), (-10, [0.6] * 5, 2)]
    ints = hard_negatives.integer_rows(with_extra(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    got = hard_negatives.mine(ints, ints.where("vec_id % 10 = 0"), 5, 5)
    expected = mine_brute(rows, 10, 5, 5)
    assert len(expected) > 100 and rows_of(got) == expected


def contract_brute(rows):
    """Every row is one, whatever its id."""
    own = [(i, (la + 1) % 10 if i is not None and i % 7 == 0 else la, [math.floor(256 * x) for x in v]) for i, v, la in rows
           if la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, la, va) in enumerate(own):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), j is None, j or 0, label) for b, (j, label, v) in enumerate(own) if b != a)
        for p, none, pid, _ in [s for s in scored if s[3] == la][:5]:
            fit = [s for s in scored if s[3] != la and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, None if none else pid, n + 1, None if u else j, -p, -s) for n, (s, u, j, _) in enumerate(fit)]
    return sorted(out, key=repr)


def test_hard_negatives_of_repeated_missing_and_large(spark, tmp_path):
    """The query counts rows of one id, and of none, each, and large components too."""
    rows = [(i * 5, v, label) for i, v, label in labelled(8, 300, 6, 4, 4)]
    rows += rows[::20] + [(i, v[::-1], 1) for i, v, _ in rows[::30]] + [(None, [1.5] * 6, label) for label in (0, 1, 2, 2)]
    rows += [(2000, [3e5, 0.5, 0.0, 0.0, 0.0, 0.0], 1), (2001, [4e5, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (2002, [3.9e5] + [0.0] * 5, 2),
             (2100, [1e7] * 6, 2), (2003, [1e7] * 6, 2), (2004, [9e6] * 6, 0), (2005, None, 1), (2006, [1.0] * 6, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    expected = contract_brute(rows)
    assert any(r[3] is None for r in expected) and rows_of(hard_negatives.op13_hard_negatives(spark, str(tmp_path))) == expected


def test_products_beyond_a_long_are_cut_to_it():
    a = np.array([[1 << 40, 1 << 40], [3, -5]])
    b = np.array([[1 << 40, 1 << 40], [1 << 40, -(1 << 40)], [-(1 << 40), 0], [1 << 22, 7]])
    most = hard_negatives.MOST
    assert hard_negatives.products(a, b).tolist() == [[most, 0, -most, (1 << 62) + (7 << 40)], [-(2 << 40), 8 << 40, -(3 << 40), (3 << 22) - 35]]


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 2)], [(100, [1.0], 1), (101, [1.0], 1)]])
def test_hard_negatives_of_few(spark, rows):
    ints = hard_negatives.integer_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert hard_negatives.mine(ints, ints.where("vec_id % 100 = 0")).collect() == []


def test_slots_keep_the_best_of_each_window():
    """A slot's best rows are kept apart from those of higher slots, so a lower window loses nothing."""
    best = hard_negatives.SlotBest(1, 2, 2)
    zero = np.zeros(4, np.int64)
    best.add(zero, np.array([0, 0, 0, 1]), np.array([9, 8, 9, 1]), np.array([1, 2, 3, 4]))
    best.add(zero[:2], np.array([0, 1]), np.array([8, 2]), np.array([5, 6]))
    assert list(zip(best.cell, best.score, best.id)) == [(0, 9, 1), (0, 9, 3), (1, 2, 6), (1, 1, 4)]
