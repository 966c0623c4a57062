from __future__ import annotations

import collections
import html
import math
import random
import re
import time

import pytest

from lectern.llm import site_tree as T

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="banner">
<nav><ul><li><a href=/>Home</a><li>Two</ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<article><header><h1>The  Title &amp; more</h1></header><p><b>First<br><p>Second&nbsp;one &lt;ok&gt;<i> in</i>line</p><ul><li>a<li>b</ul>
<aside>see also</aside><div id=comments><p>reader says</div><form><input value=x>search</form><table><tr><td>c1<td>c2</table></article>
<div class="ad">buy</div><footer>&copy; x</footer></body></html>"""


def test_article_only():
    assert T.main_text(PAGE) == "The Title & more First Second one <ok> inline a b c1 c2"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<div>x</section></div>y", "x y"), ("a < b <i>c</i>d", "a < b cd"), ("<p>open <b>tag", "open tag"), ("<script>never closed", ""), ("<p title='>'>q</p>", "q"), ("x<!-- never closed", "x"), ("<a href=1>one</a><p>&#233;&eacute;&bad;</p>", "one éé&bad;")])
def test_odd_pages(page, text):
    assert T.main_text(page) == text


def site(n: int) -> list[tuple[int, str, str]]:
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    body = lambda i: "".join(f"<p>{words[(i * 3 + j) % 8]} {i} {j}</p>" for j in range(1 + i % 4))
    return [(i, f"https://User@Site.example:80/{i}", f"<body><div class=top><span>Same words</span></div><div class=body>{body(i)}</div></body>") for i in range(n)]


@pytest.mark.parametrize("max_nodes", [1000, 0])
def test_repeated_branches_go(spark, max_nodes):
    rows = [*site(12), (99, "https://other.example/", site(1)[0][2]), (100, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in T.extract(pages, max_nodes=max_nodes).collect()}
    assert len(got) == 14 and got[100] == ""
    assert all("Same words" not in got[i] and f"{i} 0" in got[i] for i in range(12))
    assert got[99].startswith("Same words")  # one page tells nothing about its site


def test_importance_is_half_layout_and_half_content(spark):
    seen = [(1, 1, c) for c in (1, 1, 1, 2, 3)] + [(2, 1, 7)] * 5 + [(3, c, c) for c in range(4)] + [(4, 1, 1)] * 2
    tree = {r["node"]: (r["pages"], r["importance"]) for r in T.style_tree(spark.createDataFrame(seen, "node long, layout long, content long")).collect()}
    want = (math.log(5) - 3 * math.log(3) / 5) / math.log(5)
    mixed = lambda value, n: (n, pytest.approx((n * value + T.DOUBT * T.UNKNOWN) / (n + T.DOUBT)))
    assert tree == {1: mixed(want / 2, 5), 2: mixed(0, 5), 3: mixed(1, 4), 4: mixed(0, 2)}


def grown(r: random.Random, words: list[str], depth: int = 0) -> list:
    """A random element: [tag and class, parts], a part being a text or an element."""
    tag = r.choice(["div", "section", "article", "span"] if depth < 3 else ["h2", "span"])
    parts: list = []
    for _ in range(r.randint(1, 3)):
        if depth < 4 and r.random() < 0.6:
            parts.append(grown(r, words, depth + 1))
        elif not parts or not isinstance(parts[-1], str):  # neighbouring texts would be one
            parts.append(" ".join(r.choice(words) for _ in range(r.randint(1, 3))))
    return [tag, r.choice(["", "a", "b", "ad", "side", "comments"]), parts]


def spelled(e) -> str:
    return e if isinstance(e, str) else f'<{e[0]}{f" class={e[1]}" if e[1] else ""}>{"".join(map(spelled, e[2]))}</{e[0]}>'


def brute_site(pages: list[list]) -> list[str]:
    """Texts of the pages of one host by whole paths, lists and counters."""
    prior = {"ad": T.UNWANTED, "side": T.NAMED, "comments": T.REMARKS}
    seen: dict[tuple, list] = {}
    all_blocks = []
    def chars(e) -> int:
        return len(e) if isinstance(e, str) else sum(map(chars, e[2]))

    def has_article(e) -> bool:
        return not isinstance(e, str) and (e[0] == "article" or any(map(has_article, e[2])))

    for page in pages:
        nodes: dict[tuple, tuple[list, list]] = {}
        blocks: list[list] = []  # path, weight, article path, texts
        fresh = [True]
        whole, alone = sum(map(chars, page)), not any(map(has_article, page))

        def visit(e, path, weight, article):
            path = (*path, (e[0], e[1]))
            own = prior.get(e[1], 1.0)
            if alone and own > T.REMARKS and 2 * chars(e) >= whole:
                own = 1.0
            if article is None and e[0] == "article" or path == article:
                article, weight = path, 1.0
            else:
                weight = min(weight, T.UNWANTED if article and own == T.NAMED else own)
            block = e[0] != "span"
            if block:
                fresh[0] = True
            mine, look = [], []
            for part in e[2]:
                if isinstance(part, str):
                    mine.append(part)
                    look.append("#")
                    if fresh[0] or (blocks[-1][1], blocks[-1][2]) != (weight, article):
                        blocks.append([path, weight, article, []])
                        fresh[0] = False
                    blocks[-1][3].append(part)
                else:
                    inner = visit(part, path, weight, article)
                    mine.append(inner[0])
                    look.append((part[0], part[1], inner[1]))
            if block:
                fresh[0] = True
            layout, content = nodes.setdefault(path, ([], []))
            layout.append(look)
            content.append(mine)
            return mine, look

        root = ["", "", page]
        visit(root, (), 1.0, None)
        all_blocks.append(blocks)
        for path, (layout, content) in nodes.items():
            seen.setdefault(path, []).append((repr(layout), repr(content)))

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in collections.Counter(values).values()) / math.log(n)

    importance = {p: ((entropy([v[0] for v in vs]) + entropy([v[1] for v in vs])) / 2 * len(vs) + T.UNKNOWN * T.DOUBT) / (len(vs) + T.DOUBT) for p, vs in seen.items() if len(vs) > 1}
    out = []
    for blocks in all_blocks:
        inside = sum(len("".join(texts)) for _, weight, article, texts in blocks if article and weight * T.WITHIN >= T.LOW)
        outside = 1.0 if not inside else T.OUTSIDE if 2 * inside >= sum(len("".join(b[3])) for b in blocks) else T.BESIDE
        kept = []
        for path, weight, article, texts in blocks:
            above = [path[:i] for i in range(1, len(path) + 1)]
            if article is None:
                branch = min(importance.get(p, T.UNKNOWN) for p in above) * outside
            else:
                own = importance.get(article, T.UNKNOWN)
                branch = T.WITHIN * min([1.0, *(importance.get(p, T.UNKNOWN) / own for p in above if len(p) > len(article) and own >= T.LOW)])
            if weight * branch >= T.LOW - 1e-6:
                kept.append("".join(texts))
        out.append(" ".join(kept))
    return out


@pytest.mark.parametrize("max_nodes", [1000, 5, 0])
def test_against_a_tree_of_whole_paths(spark, max_nodes):
    r = random.Random(11)
    rows, want = [], {}
    for site in range(8):
        template = [grown(r, ["same", "menu"]), grown(r, ["fixed"])]
        pages = [[*(template[:1] if r.random() < 0.9 else []), *(grown(r, [f"w{i}" for i in range(r.choice([2, 400]))]) for _ in range(r.randint(1, 3))), *template[1:]] for _ in range(r.choice([1, 2, 3, 12, 25]))]
        pages += pages[:2]
        for i, text in enumerate(brute_site(pages)):
            rows.append((len(rows), f"http://h{site}.example/{i}", "".join(map(spelled, pages[i]))))
            want[len(rows) - 1] = text
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {x["page_id"]: x["text"] for x in T.extract(df, max_nodes=max_nodes).collect()}
    assert got == want
    assert sum(bool(t) for t in want.values()) > 10 and any(len(t) < len(h) / 3 for t, (_, _, h) in zip(want.values(), rows, strict=True))


def article_of(page: str) -> str:
    """The article of a page of the given tables, cut out by its marks."""
    article = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", re.sub("<!--.*?-->", "", article, flags=re.S))
    cleaned = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in parts)
    return " ".join(c for c in cleaned if c)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_pages_of_the_given_table(spark, sf, scale):
    pages = spark.read.parquet(f"{sf}/../{scale}/pages.parquet")
    want = {r["page_id"]: article_of(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in T.extract(pages).collect()}
    assert got == want


def test_the_tree_decides_without_names(spark, sf):
    """With neutral tags and classes menus and adverts go by what the pages of a host have in common."""
    rows = [(r["page_id"], r["url"], r["html"].replace("<nav>", "<div>").replace("</nav>", "</div>").replace('class="ad"', 'class="x"')) for r in spark.read.parquet(f"{sf}/../sf0.1/pages.parquet").collect()]
    hosts = collections.Counter(T.host_of(u) for _, u, _ in rows)
    want = {i: article_of(page) for i, u, page in rows if hosts[T.host_of(u)] >= 5}
    got = {r["page_id"]: r["text"] for r in T.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    right = sum(got[i] == text for i, text in want.items())
    assert right >= 0.95 * len(want) > 0, (right, len(want))


@pytest.mark.parametrize("name", ["class=reader-comments", "class=user-comments", "id=comments-section", "class=site-nav", "class=page-footer", "class=cookie-message", "class='box sidebar-left'", "class=alert", "class=teaser", "class=related_posts", "id=comment-list-2"])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_names_inside_and_outside(name, tag):
    gone = f"<{tag} {name}><p>something else</{tag}>"
    body = "<p>A body of some length</p>"
    assert T.main_text(f"<body><main>{body}{gone}</main></body>") == "A body of some length"
    assert T.main_text(f"<body><article>{body}</article><div {name}><p>something else</div></body>") == "A body of some length"
    if tag == "div":
        assert T.main_text(f"<body>{body}{gone}</body>") == "A body of some length"


def test_what_holds_most_of_a_page_stays():
    body = "<p>A body of some length</p>"
    assert T.main_text(f"<body><form>{body}<p>and more</form></body>") == "A body of some length and more"
    assert T.main_text(f"<body><form><nav>x</nav><article>{body}</article></form></body>") == "A body of some length"
    assert T.main_text(f"<article>{body}<div class=comment>Our comment</div></article>") == "A body of some length Our comment"
    assert T.main_text(f"<article>{body}<form>Your name</form></article>") == "A body of some length"


@pytest.mark.parametrize("max_nodes", [1000, 0])
def test_entropy_decides_inside_and_outside_articles(spark, max_nodes):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    cards = lambda i: f"<article class=card>card {words[i % 8]} {i}</article>"
    page = lambda i: f"<body><div class=slogan>Always this</div><div class=body><p>body {words[i % 8]} {i}</p></div>{cards(i)}<div class=side>note {i}</div><div class=related>Same note</div></body>"
    inner = lambda i: f"<body><article><h1>head {i}</h1><p>text {words[i % 8]} {i}</p><div class=box>Sign up here</div></article></body>"
    rows = [(i, f"https://cards.example/{i}", page(i)) for i in range(8)] + [(100 + i, f"https://inner.example/{i}", inner(i)) for i in range(8)]
    rows += [(200 + i, f"https://copies.example/{i}", inner(0)) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in T.extract(pages, max_nodes=max_nodes).collect()}
    for i in range(8):
        assert got[i] == f"body {words[i]} {i} card {words[i]} {i}"
        assert got[100 + i] == f"head {i} text {words[i]} {i}"
    assert all(got[200 + i] == "head 0 text alpha 0 Sign up here" for i in range(4))  # copies tell nothing about a template


@pytest.mark.parametrize(
    "page,text",
    [
        ('<div class="layout has-sidebar"><article><p>kept</article></div>', "kept"),
        ('<div id="page-with-sidebar"><p>kept</div>', "kept"),
        ('<div class="sidebar"><div class="ad"><main><p>kept</main></div></div>', "kept"),
        ('<article><div class="entry-header"><h1>Title</h1></div><div class="header"><h2>Sub</h2></div><p>kept</article>', "Title Sub kept"),
        ('<div class="side">first<div class="notice">second</div><div class="comments">third</div></div>', "first"),
        ("<nav><article><p>gone</article></nav><p>kept", "kept"),
    ],
)
def test_names_only_lower_the_weight(page, text):
    assert T.main_text(page) == text


@pytest.mark.parametrize("page", ['<a x="' * 170_000, "<div>" * 100_000 + "deep", "<b><div>" + "<i>" * 100_000 + "x" + "</b>" * 100_000, "<p>" * 200_000 + "</div>" * 100_000, "<!-- " * 200_000, "<a b='" * 100_000 + "<table><tr><td>" * 30_000, "word " * 400_000])
def test_time_grows_with_the_page(page):
    began = time.perf_counter()
    T.main_text(page)
    assert time.perf_counter() - began < 10


def test_the_tree_sees_all_nodes_and_decides(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = T.parsed(pages)
    assert T.observations(rows).count() > 5 * pages.count()
    # a form that wraps changing pages is no form to drop; one that is the same on each page is
    wrap = lambda i: f"<form id=page>{f'<p>line {i}' * (i + 1)}</form><form id=find>Search <b>here</b></form>"
    df = spark.createDataFrame([(i, "http://f.example/", wrap(i)) for i in range(12)] + [(20, "http://f.example/", None), (21, None, "")], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in T.extract(df).collect()}
    assert all(got[i] == " ".join([f"line {i}"] * (i + 1)) for i in range(12)) and got[20] == got[21] == ""


def test_repeated_rows_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://r.example", "<p>a", 5)] * 2 + [(None, "http://r.example", "<p>b", 6)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["text"]) for r in T.extract(df).collect()) == [(0, "b"), (1, "a"), (1, "a")]
    assert T.extract(df.limit(0)).count() == 0
