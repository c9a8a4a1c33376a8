import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeforge.llm import html_lines, main_text, neighbours

SF = "/root/testdata/sf0.01"


def test_neighbours_recall_and_scores(spark):
    got = {}
    for r in neighbours.op6_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:20]
        own = sorted(got[ids[i]])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(s[np.flatnonzero(ids == v)[0]] - score) < 1e-12 for _, v, score in own)
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        found += len({v for _, v, _ in own} & {ids[j] for j in order})
        total += 20
    assert found >= 0.9 * total


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (20, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in neighbours.neighbours(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.neighbours(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_equal_vectors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VALUES", 1200)
    rows = [(i, [1.0, 0.0, 0.0, 1.0]) for i in range(400)] + [(400 + i, [float(i % 7), 1.0, float(i % 5), 0.0]) for i in range(200)]
    got = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    x = np.array([v for _, v in rows])
    s = x @ x[0]
    order = [j for j in np.lexsort((np.arange(600), -s)) if j != 0][:20]
    assert len({r.vec_id for r in got} & set(order)) >= 18


def test_cells_are_those_of_single_steps():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    index = neighbours.MultiIndex(x, len(x))
    first, second = index.cells(x)
    counts = index.counts(first, second)
    for q in rng.normal(size=(20, 8)):
        a, b = index.scores(q)
        sums = np.sort(a[first] + b[second])[::-1]
        for wanted in (1, 7, 300, 2999):
            assert index.least_sum(q, counts, wanted) == sums[wanted - 1]
        assert index.least_sum(q, counts, 3000) == -np.inf


def test_repeated_candidates_are_listed_once(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6)).tolist()
    rows = list(enumerate(x)) + [(7, x[7])] * 30 + [(9, [-v for v in x[9]]), (0, x[0]), (20, x[21])]
    got: dict = {}
    for r in neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 20, 40):
        best: dict = {}
        for own in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    score = 0.0
                    for a, b in zip(v, own, strict=True):
                        score += a * b
                    best[i] = max(best.get(i, -1e9), score)
        assert got[q] == sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20]


def test_recall_on_many_vectors(spark):
    """2,000 rows, which nothing clusters, and as many in clusters: recall, and scores to the last bit."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(1)
    base = rows.collect()
    made = [(10_000 + r.vec_id, (np.array(r.embedding) * 0.2 + rng.normal(size=64) * 0.01 + np.eye(64)[r.vec_id % 40]).tolist()) for r in base]
    every = [(r.vec_id, [float(v) for v in r.embedding]) for r in base] + made
    ids, x = np.array([i for i, _ in every]), np.array([v for _, v in every])
    got: dict = {}
    for r in neighbours.neighbours(spark.createDataFrame(every, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    found = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = neighbours.products(x, np.broadcast_to(x[i], x.shape))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:20]
        found += len({ids[j] for j in order} & set(got[ids[i]]))
        total += 20
        assert all(got[ids[i]][v] == s[np.flatnonzero(ids == v)[0]] for v in got[ids[i]])
    assert found >= 0.9 * total


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        places = sorted(html_lines.shared(a, b))
        rest = iter(b)
        assert len(places) == longest(a, b) and all(a[i] in rest for i in places)


def test_lines_of_a_page():
    page = '<title>t</title><body><nav><ul><li><a>x</a><li>y</ul></nav><div class="ad">buy</div><script>var t="</p>";</script><article><h1>T &amp; a</h1><p><b>One<br>two<p>thr<i>ee</i></p><div class="comments"><p>hi</div></article><!-- <p>no</p> --><p>out<footer>&copy; z'
    assert [x[:2] for x in html_lines.lines(page)] == [("x", 2), ("y", 2), ("buy", 2), ("T & a", 1), ("One", 1), ("two", 1), ("three", 1), ("hi", 2), ("out", 0), ("© z", 2)]
    assert html_lines.lines("") == [] and html_lines.lines("a < b <i>c</i> &am") == [("a < b c &am", 0, False)]


def test_pages_are_differenced(spark):
    body = lambda n: f"<body><p>Welcome to the site</p><p>Story number {n}</p><p>All rights of it</p>"
    rows = [(n, f"http://h.org/a/{n}", body(n)) for n in range(30)]
    rows += [(100, "http://other.org/x", body(100)), (101, None, "<article>kept</article><p>gone</p>"), (102, "not a url", None), (103, "http://h.org/a/0", body(0)), (None, "http://h.org/b", "<main>m</main>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("key", F.lit("y"))
    got = [(r.page_id, r.text) for r in main_text.extracted(frame).collect()]
    texts = dict(got)
    assert len(got) == len(rows)
    assert all(texts[n] == f"Story number {n}" for n in range(1, 30))
    assert texts[100] == "Welcome to the site Story number 100 All rights of it" and texts[101] == "kept" and texts[102] == "" and texts[None] == "m"
    assert main_text.extracted(frame.limit(0)).count() == 0


def test_main_text_is_the_article(spark):
    import html
    import re

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in main_text.op7_main_text(spark, SF).collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", rows[r.page_id], re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert r.text == text and r.n_chars == len(text)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_copies_do_not_delete_each_other(spark, partitions):
    body = lambda n: f"<body><p>Welcome to the site</p><p>Story number {n}</p><p>All rights of it</p>"
    rows = [(10 * n + i, f"http://h.org/a/{n}/{i}", body(n)) for n in range(4) for i in range(6)]
    rows += [(1000 + i, "http://h.org/a/1/3", body(1)) for i in range(5)]  # copies at the same URL
    rows += [(2000 + i, f"http://alone.org/{i}", body(7)) for i in range(3)]  # a host with nothing but copies
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.page_id: r.text for r in main_text.extracted(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    for page, _, page_html in rows:
        story = page_html.split("<p>")[2].removesuffix("</p>")
        assert got[page] == (story if page < 2000 else f"Welcome to the site {story} All rights of it")


def differenced(rows):
    """Texts by brute force: rows are (page_id, host, path, own lines, all lines), of pages without an article."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    out = {}
    for i, (page, host, path, own, _) in enumerate(rows):
        near = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(rows) and rows[j][1] == host and rows[j][3] == own:
                j += step
            if 0 <= j < len(rows) and rows[j][1] == host:
                near.append(rows[j])
        common = lambda r, path=path: next((n for n, (a, b) in enumerate(zip(r[2], path, strict=False)) if a != b), min(len(r[2]), len(path)))
        if near:
            other = max(near, key=common)[4]
            n = longest(own, other)
            gone = html_lines.shared(own, other)
            assert len(gone) == n
            own = [x for k, x in enumerate(own) if k not in gone]
        out[page] = " ".join(own)
    return out


@pytest.mark.parametrize("partitions", [1, 3, 60])
def test_pages_without_article_and_furniture_inside_main(spark, partitions):
    rng = random.Random(partitions)
    stories = [f"story {i}" for i in range(30)]
    rows, truth = [], []
    for n in range(150):
        host = rng.choice(["a.org", "b.org", "c.org"])
        own = ["menu of the site", *rng.sample(stories, rng.randint(0, 4)), "read more", rng.choice(stories), "read more", f"(c) {host}"]
        if rng.random() < 0.3 and truth:  # a copy at a URL of its own
            own = truth[-1][3]
        path = f"/{rng.randrange(4)}/{n:03d}"
        head = [f"head of {host}"]
        main = rng.random() < 0.5
        lines = "".join(f"<p>{x}</p>" for x in own)
        html = f"<body><nav>go</nav><p>{head[0]}</p><main>{lines}</main>" if main else f"<body><nav>go</nav>{lines}"
        rows.append((n, f"http://{host}{path}", html))
        truth.append((n, host, path, own, ["go", *(head if main else []), *own]))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.page_id: r.text for r in main_text.extracted(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got == differenced(truth)


def test_repeated_lines_go_by_place(spark):
    rows = [(1, "http://h.org/a", "<p>same<p>one<p>same"), (2, "http://h.org/b", "<p>two<p>same"), (3, "http://h.org/c", "<main><p>three<article><p>same</article></main>")]
    got = {r.page_id: r.text for r in main_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got in ({1: "same one", 2: "two", 3: "same"}, {1: "one same", 2: "two", 3: "same"})


WHOLE = "<p>The one text of it.</p><p>And more of that.</p>"


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single sidebar-right"><article>{}</article>', '<html class="no-js menu-closed"><body><article>{}</article>', "<body><form><nav>x</nav><article>{}</article></form>", "<body><form><nav>x</nav><main>{}</main></form>",
        '<div class="sidebar layout"><div id="menu"><article>{}</article></div></div>', '<article><div class="share-price">{}</div></article>', '<article><section class="notice-of-meeting">{}</section></article>',
        '<div class="sidebar"><article>A teaser that is by far the longest of all the texts that stand in this page.</article></div><article>{}</article>', '<article>{}<div class="comments"><p>Me too</p></div><footer>By one</footer><div class="share-links"><a>Send</a></div></article>',
        '<article>{}<div class="ad-by-us"><a>Buy this now</a></div></article>', '<div class="header"><main>{}</main></div>', '<div class="menu">{}</div>', "<form>{}</form>", '<div class="page-header">{}</div>',
    ],
)
def test_marks_do_not_empty_a_page(spark, page):
    rows = spark.createDataFrame([(1, "http://h.org/a", page.format(WHOLE))], "page_id long, url string, html string")
    assert main_text.extracted(rows).first().text == "The one text of it. And more of that."


def test_titles_stay_and_teasers_go(spark):
    page = '<header><h1>Site</h1></header><article><header class="header"><h1>Title</h1></header>{}</article><aside><article>Teaser</article></aside>'
    rows = spark.createDataFrame([(1, "http://h.org/a", page.format(WHOLE))], "page_id long, url string, html string")
    assert main_text.extracted(rows).first().text == "Title The one text of it. And more of that."


def test_the_nearest_page_decides_about_hints(spark):
    page = '<article><p>Shared by both</p><p>Story {0}</p><div class="share-price">Price {1}</div><div class="notice-of-meeting">Always said</div></article>'
    rows = [(n, f"http://h.org/{n // 2}/{n % 2}", page.format(n, n // 2)) for n in range(6)]
    got = {r.page_id: r.text for r in main_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Shared by both Story {n}" for n in range(6)}  # the pair has the price, and every page the notice
    rows = [(n, f"http://h.org/{n}", page.format(n, n)) for n in range(4)]
    got = {r.page_id: r.text for r in main_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Shared by both Story {n} Price {n}" for n in range(4)}


def test_articles_without_hints_are_differenced(spark):
    page = '<nav>Home</nav><article><ul><li><a href="/">Start of the site</a><li><a href="/{0}">Part {0}</a></ul><p>A passage of both, <a href="/x">by x</a>.</p><p>Story {0}</p></article>'
    rows = [(n, f"http://h.org/{n}", page.format(n)) for n in range(40)] + [(99, "http://alone.org/", page.format(99))]
    got = {r.page_id: (r.text, r.n_shared) for r in main_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: (f"Part {n} A passage of both, by x. Story {n}", 2) for n in range(40)} | {99: ("Start of the site Part 99 A passage of both, by x. Story 99", 0)}


def test_shared_lines_of_the_given_articles(spark):
    from os.path import commonprefix

    rows = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        host, path = re.match(r"[a-z]+://([^/?#:]*)[^/?#]*([^#]*)", r.url.lower()).groups()
        found = html_lines.lines(r.html)
        rows.append((host, path, r.page_id, [x for x, k, _ in found if k == html_lines.ARTICLE], [x for x, _, _ in found]))
    rows.sort(key=lambda r: r[:3])
    assert len({r[:2] for r in rows}) == len(rows)
    truth = {}
    for i, (host, path, page, own, _) in enumerate(rows):
        near = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(rows) and rows[j][0] == host and rows[j][3] == own:
                j += step
            near += [rows[j]] if 0 <= j < len(rows) and rows[j][0] == host else []
        truth[page] = longest(own, max(near, key=lambda r: len(commonprefix([r[1], path])))[4]) if near else 0
    assert {r.page_id: r.n_shared for r in main_text.op7_main_text(spark, SF).collect()} == truth and sum(truth.values()) > 0


def test_broken_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 50_000 + "</x></y>" * 50_000, "<nav>" * 50_000 + "x", "<form><nav>" * 30_000 + "x", "<article>" * 20_000 + "x"):
        html_lines.lines(page)
    assert time.time() - began < 20


def test_shared_lines_of_long_pages():
    rng = random.Random(3)
    a = [rng.randrange(20_000) for _ in range(20_000)]
    b = sorted(a, key=lambda x: (x // 50, rng.random()))
    small = lambda x, y: len(html_lines.shared(x, y))
    assert small([1, 2, 3, 2, 4, 1, 2], [2, 4, 3, 1, 2, 1]) == 4 and small([5] * 200, [5] * 90) == 90
    assert 100 < small(a, b) < 20_000
