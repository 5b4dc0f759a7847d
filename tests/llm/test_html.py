import html.parser
import random
import time

import pytest

from strataloom.llm import html_text as h


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1]


@pytest.mark.parametrize("seed", range(5))
def test_common_lines(seed):
    rng = random.Random(seed)
    for _ in range(80):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(24))] for _ in range(2))
        kept = [x for x, k in zip(a, h.common_lines(a, b)) if k]
        rest = iter(b)
        assert len(kept) == brute_lcs(a, b)[-1] and all(x in rest for x in kept)
        assert h._lengths(a, b) == brute_lcs(a, b)


def text(page):
    lines = h.blocks(page)
    return h.main_text(lines, list(range(len(lines))), None)[0]


CASES = [
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a<p>b <b>c</b>d<br>e", "a b cd e"),
    ("<body><nav><a>x</a></nav><header>h</header><article><h1>T</h1><p>one\n  two&nbsp;&lt;3</p></article><footer>f</footer>", "T one two <3"),
    ("<body><div class='cookie-notice'>ok?<article><p>body</p></article>", "body"),
    ("<article><p>a</p><script>var t='</p>';</script><style>p{}</style><!-- no --><form>f</form>b</article>", "a b"),
    ("<main><p>text</p><section id=comments><article class=comment>hi</article></section></main>", "text"),
    ("<div class=content><p>1 < 2 and 3 > 2</p></div><aside>s</aside>", "1 < 2 and 3 > 2"),
    ("<body class=has-sidebar><article class=post><p>kept</p></article></body>", "kept"),
    ("<p title='a>b'>x</p><p", "x"),
    ("<article><p>x</article><div role=navigation>n</div>", "x"),
    ("<article><h1>T</h1><div class='search-results-review'><p>Body</p></div><section id='notice-periods'><p>Law text</p></section></article>", "T Body Law text"),
    ("<article><section id='related-work'><p>Related work text</p></section></article>", "Related work text"),
    ("<article><section id=menu><p>Soup</p></section><h2 class=notice id=comment>H</h2><div class='post-header'>By</div></article>", "Soup H By"),
    ("<article><p>a</p><div class='ad-slot'>x</div><div class='site-footer'>y</div><ol class='comment-list'><li>z</ol><div id='comments'>w</div></article>", "a"),
    ("<div class='layout has-sidebar'><p>a</p><div class='left sidebar'>s</div></div>", "a"),
    ("<body><form id=aspnetForm><input type=hidden><main><article><h1>T</h1><p>Body text.</p></article></main><input type=submit></form><footer>f</footer>", "T Body text."),
    ("<body><form id=f><p>Most of the text is in here.</p><button>go</button></form><p>tail</p>", "Most of the text is in here. tail"),
    ("<article><p>a long enough text</p><div class='life-form'>b</div><section class='order-menu'>c</section><p class='alert'>d</p></article>", "a long enough text b c d"),
    ("<article><p class='share'>a</p><div class='team comments-policy'>b</div><p class='notice'>c</p><span class=ad>x</span>d</article>", "a b c d"),
    ("<div class='modal'><article><p>kept</p></article></div>", "kept"),
    ("<div class='sidebar'><article><p>teaser</p></article></div><main><p>kept</p></main>", "kept"),
    ("<nav><ul><li>n<main><p>nav was not closed</p></main>", "nav was not closed"),
    ("<div><article><p>a</p></p></td>b</article></div>", "a b"),
    ("<div hidden><article><p>no</p></article></div><article><p>yes</p></article>", "yes"),
    ("<table><tr><td>a<td>b<tr><td>c</table><ul><li><p>d<li>e</ul>", "a b c d e"),
    ("<article><p>a<aside>x</aside><form>y</form><nav>z</nav><footer>f</footer><p>b</article>", "a b"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_main_text(page, want):
    assert text(page) == want


def test_flags_survive_the_way():
    lines = h.blocks("<nav>n</nav><article><p>é\U0001f600</article>tail")
    assert h.unpack_lines(h.pack_lines(lines)) == lines and h.unpack_lines(h.pack_lines([])) == []


def test_urls():
    assert h.host_path("HTTPS://u@A.example:80/x/y/?q#f") == ("a.example:80", "/x/y?q")
    assert h.host_path("//a.example") == ("a.example", "/") and h.host_path(None) == (None, None) and h.host_path("/p/q") == ("", "/p/q")


def test_pages_are_paired_and_differenced(spark):
    page = "<div>Site name</div><div>{}</div><div>All rights reserved</div>"
    rows = [
        (1, "http://a.example/x/1", page.format("first")),
        (2, "http://a.example/x/2", page.format("second")),
        (3, "http://b.example/x/1", page.format("alone")),
        (4, None, page.format("no url")),
        (5, "http://c.example/1", page.format("mirror")),
        (6, "http://c.example/2", page.format("mirror")),
        (7, "http://a.example/x/9", None),
        (1, "http://a.example/x/1", page.format("first")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as path", "'y' as lines")
    got = sorted((r.page_id, r.text) for r in h.extract(df).collect())
    whole = "Site name {} All rights reserved"
    assert got == [(1, "first"), (1, "first"), (2, "second"), (3, whole.format("alone")), (4, whole.format("no url")), (5, whole.format("mirror")), (6, whole.format("mirror")), (7, "")]
    assert h.extract(df.limit(0)).count() == 0


def test_neighbours_do_not_depend_on_partitions(spark):
    page = "<div>common {}</div><div>own {}</div>"
    rows = [(i, f"http://h.example/{i % 7}/{i}", page.format(i % 7, i)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted((r.page_id, r.text) for r in h.extract(df.repartition(int(n))).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] and results[0][0] == (0, "own 0")


def brute(rows):
    """The whole operator by sorting, comparing and the table of the longest common subsequence."""
    parsed = [(i, u, *h.host_path(u), h.blocks(page or "")) for i, u, page in rows]
    first = {}
    for i, _, host, path, lines in parsed:
        if host is not None:
            first[host, path] = min(first.get((host, path), (i, lines)), (i, lines), key=lambda x: (x[0], h.line_hashes([t for t, _, _ in x[1]])))
    order, out = sorted(first), []
    for i, u, host, path, lines in parsed:
        body = [(t, k) for k, (t, s, a) in enumerate(lines) if not s and (a or not h.marked(lines))]
        if host is not None and not h.marked(lines):
            at = order.index((host, path))
            near = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order) and order[j][0] == host]
            if near:
                other = max(near, key=lambda x: h.shared_prefix(x[1], path))
                a, b = ([t for t, _, _ in x] for x in (lines, first[other][1]))
                shared = h.common_lines(a, b)
                assert sum(shared) == brute_lcs(a, b)[-1]
                body = [x for x in body if not shared[x[1]]] or body
        out.append((i, u, " ".join(t for t, _ in body)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_whole_operator(spark, partitions):
    """Hosts with and without articles, one host with most pages, queries in URLs, repeated and null rows."""
    rng = random.Random(3)
    site = ["<div>Home</div>", "<p>All rights reserved</p>", "<div>Imprint</div>", "<span>Follow us</span>"]

    def page(i):
        own = [f"<p>text {rng.randrange(9)}</p>" for _ in range(rng.randrange(5))]
        lines = site[:2] + own + rng.sample(site, 2)
        if i % 3 == 0:
            return "<nav>n</nav>" + "".join(site) + "<article>" + "".join(own) + "</article>"
        return "".join(lines)

    rows = [(i, f"http://{'hot' if i % 4 else f'h{i % 9}'}.example/index.php?id={rng.randrange(60)}" if i % 2 else f"http://m{i % 5}.example/a/{i}/", page(i)) for i in range(150)]
    rows += [(200, None, page(1)), (201, "http://hot.example/z", None), (202, "http://hot.example/y", ""), (None, "http://hot.example/x", page(2)), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    rows = [tuple(r) for r in df.collect() if r.page_id is not None]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = sorted(((r.page_id, r.url, r.text) for r in h.extract(df.where("page_id is not null")).collect()), key=str)
        assert h.extract(df).count() == 156
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute(rows)


def test_query_keeps_marked_articles_whole(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = h.op4_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        lines = h.blocks(pages[r.page_id].html)
        assert h.marked(lines) and r.text == " ".join(t for t, s, a in lines if a and not s) and r.n_chars == len(r.text) and r.n_deleted == 0


class Plain(html.parser.HTMLParser):
    """Well-formed pages by the library's parser: texts with the elements around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.text = [], [], []

    def flush(self):
        if t := " ".join("".join(self.text).split()):
            self.found.append((t, list(self.open)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "i"):
            self.flush()
            self.open.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag not in ("b", "i"):
            self.flush()
            self.open.pop()

    def handle_data(self, data):
        self.text.append(data)


def plain_text(page):
    p = Plain()
    p.feed(page)
    p.flush()

    def gone(path):
        seen = False
        for tag, attrs in path:
            c = attrs.get("class")
            if tag in ("nav", "aside", "footer", "script") or "hidden" in attrs or c == "comments" or attrs.get("role") == "navigation":
                return True
            if tag == "header" and not seen or c in ("ad", "site-footer") or c == "sidebar" and not seen:
                return True
            seen = seen or tag in ("article", "main")
        return False

    lines = [(t, any(x in ("article", "main") for x, _ in path)) for t, path in p.found if not gone(path)]
    return " ".join(t for t, a in lines if a or not any(x for _, x in lines))


def random_page(rng, with_article):
    count = [0]

    def text():
        count[0] += 1
        return f"w{count[0]} &amp; {rng.choice(['x  y', '<b>z</b>', '&lt;tag&gt;', 'q'])}"

    def element(depth):
        tag = rng.choice(["div", "p", "section", "ul", "nav", "aside", "footer", "header", "script"])
        attrs = rng.choice(["", "", "", " class=ad", " class='comments'", " hidden", " role=navigation", " class='site-footer'", " class=sidebar", " class='life-form'"])
        if tag in ("p", "script"):
            return f"<{tag}>{text()}</{tag}>"
        inner = "".join(element(depth - 1) if depth and rng.random() < 0.6 else f"<p>{text()}</p>" for _ in range(rng.randrange(4)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    body = [element(3) for _ in range(4)]
    if with_article:
        body.insert(rng.randrange(4), "<article><h1>T</h1>" + "".join(element(2) for _ in range(5)) + "</article>")
    else:  # enough text outside all frames
        body.append("<p>" + "plain text " * 200 + "</p>")
    return "<html><body>" + "".join(body) + "</body></html>"


@pytest.mark.parametrize("seed", range(4))
def test_parser_against_the_library(seed):
    rng = random.Random(seed)
    for i in range(60):
        page = random_page(rng, i % 2)
        assert text(page) == plain_text(page), page


def test_time_is_linear():
    for unit in ("<div></b>", "<b>", "<b><p></p>", "<article><div class=ad>", "<p><li></p>", "<form><article>", "</p><article>", "<td><tr>"):
        page = unit * (1_000_000 // len(unit)) + "<p>end"
        began = time.time()
        h.blocks(page)
        assert time.time() - began < 6, unit


def test_null_ids_and_clashing_names(spark):
    rows = [(None, "http://a.example/1", "<p>x</p><p>one</p>"), (None, "http://a.example/2", "<p>x</p><p>two</p>"), (3, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as lines", "2 as hashes", "'t' as text", "true as open", "0 as part", "5 as n_deleted")
    got = h.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_deleted"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, rows[0][1], "one", 1), (None, rows[1][1], "two", 1), (3, None, "", 0)], key=str)


def test_marked_pages_are_differenced(spark):
    """Of two marked articles on a host, a block called a part of the site goes only if the other page has it too."""
    page = "<article><h1>{0}</h1><p>the same sentence</p><div class='share-box'><p>Send this to a friend</p></div><p>{0} text</p><div class=notice>{1}</div><div class='life-form'>moss</div></article>"
    rows = [(1, "http://a.example/x/1", page.format("first", "one")), (2, "http://a.example/x/2", page.format("second", "two")), (3, "http://b.example/", page.format("third", "one"))]
    rows += [(4, "http://c.example/1", rows[0][2]), (5, "http://c.example/2", rows[0][2])]  # mirrors
    got = {r.page_id: (r.text, r.n_deleted) for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "{0} the same sentence Send this to a friend {0} text {1} moss"
    assert got[1] == ("first the same sentence first text one moss", 1) and got[2] == ("second the same sentence second text two moss", 1)
    assert got[3] == (whole.format("third", "one"), 0) and got[4] == got[5] == (whole.format("first", "one"), 0)
    # A block that is most of an article is no part of the site, whatever its name.
    frame = "<article><h1>{}</h1><div class=form><p>the rules of the game in full</p></div></article>"
    assert all(a == 1 for _, _, a in h.blocks(frame.format("A")))
