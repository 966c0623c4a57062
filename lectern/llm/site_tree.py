"""Main text of pages by a site style tree.

The DOMs of all pages of a host are merged by element path (tag with class, id and role; digits in these count alike). Every merged node
gets an importance from 0 to 1: half of it from its presentation, the entropy of the layouts seen under it, half from its content,
the entropy of the texts seen in it. A node that looks and reads the same on page after page has none; one with a fixed layout and changing
texts, such as a menu, an advert or a footer, has about half. As a few pages prove little, UNKNOWN counts as the importance of DOUBT further pages; a node of
one page has just that.

A block of text stays if its prior weight times the importance of its branch is not below LOW. The importance of a branch is the least one of the
nodes that the block stands in; inside an article or main element it is WITHIN times that of the nodes from there inwards, in proportion to the
importance of the article itself, and an article that is itself the same on page after page is a copy, not a template: its insides are not judged.
Outside the articles of a page the weight is OUTSIDE where they hold at least half of its text, BESIDE where they hold some, so there a fixed layout
is enough to go, whatever the tags and names; and LINKS for blocks that are mostly links. Tags and names lower it further: SURROUNDINGS for elements that by tag
or role are navigation, footers, asides, forms or dialogs; and by the words that a class token or id begins or ends with, NAMED for sidebars, menus, notices and the like (UNWANTED
inside an article), HEADED for headers, UNWANTED for adverts and cookies, REMARKS for reader comments (which vary as much as articles do, so that entropy
can't tell them apart). An outermost article or main element is free of its own names and of those around it; a form that holds half of a page's
text, and without an article a named element that does, lowers nothing. Text of scripts, styles, titles and controls is no text of a page.

Each page is parsed once; blocks and nodes are written to the shared folder. Counts are grouped sums with partial aggregation, so a host may
hold any share of all pages. The importances of at most MAX_BROADCAST_NODES nodes, those with the most pages, go to the tasks as two arrays; those of further
nodes (none of which has more than one part in MAX_BROADCAST_NODES of all rows) come by a join, a list a page and no longer than the page's own nodes.

Defined results: null and empty html give an empty text; text outside any element counts as a block of the page; unclosed and stray tags are
repaired; a tag that never ends is text, and after it quotes no longer protect a `>`; without an article or main element all blocks are judged alike; repeated
rows count as pages of their own; an empty table gives no rows; only the three named columns are read. Parsing takes time and memory in proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import shared_dir

MIN_PAGES = 2
#: Share of presentation (the rest is content) in a node's importance, the importance of nodes on too few pages, the number of pages that it counts for
#: beside those seen, and the importance below which a block goes.
PRESENTATION_SHARE = 0.5
UNKNOWN = 0.5
DOUBT = 3
LOW = 0.2
#: Prior weights.
OUTSIDE = 0.35
BESIDE = 0.6
WITHIN = 0.66
LINKS = 0.5
HEADED = 0.45
NAMED = 0.35
SURROUNDINGS = 0.3
UNWANTED = 0.3
REMARKS = 0.1
MAX_BROADCAST_NODES = 1_000_000
OUT_BYTES = 4 << 20

# Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
SILENT_TAGS = frozenset("script style noscript template iframe svg math head title button select textarea input object embed canvas".split())
SURROUNDING_TAGS = frozenset("nav footer aside form menu dialog".split())
SURROUNDING_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADED_WORDS = frozenset("banner header head masthead comment".split())
NAMED_WORDS = frozenset(
    "alert alerts breadcrumb breadcrumbs copyright foot footer menu nav navbar navigation notice notices overlay pager pagination promo promotion rail recommended related search share sharing side sidebar skip social teaser teasers toolbar widget widgets".split()
)
UNWANTED_WORDS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login".split())
REMARKS_WORDS = frozenset("comments reply replies respond discussion disqus".split())
REMARKS_NAMES = frozenset("comment-list comment-form comment-area comment-thread".split())
#: A name that begins so tells of something beside its element.
BESIDE_WORDS = frozenset("has with without no not".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body div article section main ul ol dl table td th nav footer header aside form blockquote".split())
_ANY_P = {"p"}

_REST = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|[^<]++|<"
#: Tokens while quoted values protect a `>`, after a tag that never ended, and after the last `>`.
_TOKENS = (
    re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|""" + _REST, re.S),
    re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|" + _REST, re.S),
    re.compile("()()().++", re.S),
)
_BEGINS = re.compile("</?[a-zA-Z]")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NAMES = re.compile(r"""\s(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile("[a-z]+")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_MASK, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15
_TEXT = xxhash.xxh64_intdigest(b"#text")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def named(token: str) -> float:
    """The prior weight of a class token or id by the words it begins and ends with."""
    words = _WORDS.findall(token)
    if not words or not BESIDE_WORDS.isdisjoint(words):
        return 1.0
    ends = {words[0], words[-1]}
    if not REMARKS_WORDS.isdisjoint(ends) or "-".join(words[:2]) in REMARKS_NAMES:
        return REMARKS
    return next((weight for known, weight in ((UNWANTED_WORDS, UNWANTED), (NAMED_WORDS, NAMED), (HEADED_WORDS, HEADED)) if not known.isdisjoint(ends)), 1.0)


def element(name: str, attributes: str) -> tuple[str, float, float]:
    """Name with class, id and role, and the prior weights by tag and role, and by names."""
    label, by_tag, by_name = name, 0.0 if name in SILENT_TAGS else SURROUNDINGS if name in SURROUNDING_TAGS else 1.0, 1.0
    if attributes:
        for key, a, b, c in _NAMES.findall(attributes):
            value, key = (a or b or c).lower(), key.lower()
            label += {"class": ".", "id": "#", "role": "@"}[key] + _DIGITS.sub("0", value)
            if key == "role":
                by_tag = min(by_tag, SURROUNDINGS) if value in SURROUNDING_ROLES else by_tag
            elif name not in ("html", "body"):
                by_name = min([by_name, *(named(token) for token in value.split())])
    return label, by_tag, by_name


@dataclass
class Parsed:
    """Blocks of a page (text, prior weight, node) and its nodes: id, parent, outermost article (or -1), hashes of layout and of content. Parents come first."""

    texts: list[str]
    weights: list[float]
    at: list[int]
    ids: list[int]
    parents: list[int]
    articles: list[int]
    layouts: list[int]
    contents: list[int]


class _Open:
    """An open element."""

    __slots__ = ("name", "by_tag", "by_name", "link", "node", "layout", "content", "wrap", "before")

    def __init__(self, name: str, by_tag: float, by_name: float, link: bool, node: int, wrap: int = -1, before: int = 0):
        self.name, self.by_tag, self.by_name, self.link, self.node, self.layout, self.content, self.wrap, self.before = name, by_tag, by_name, link, node, 0, 0, wrap, before


def parse(page: str, host: str = "", low: float = LOW, free: frozenset[int] = frozenset()) -> Parsed:
    """`free` has the numbers of forms and named elements that hold most of the page and so don't lower the weight of what is in them."""
    root = xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))
    ids, parents, articles, layouts, contents = [root], [-1], [-1], [0], [0]
    place = {root: 0}
    top = _Open("", 1.0, 1.0, False, 0)
    stack = [top]
    # for each open element that bounds implied closing: how many of each name are open inside of it, and how many such elements are open
    inner: list[dict[str, int]] = [{}]
    scopes = dict.fromkeys(SCOPES, 0)
    blocks: list[tuple[str, float, int, int, int]] = []  # text, weight, node, characters in links, characters
    parts: list[str] = []
    first: tuple[int, float, int] | None = None  # node, weight, article
    blank, linked = True, 0
    seen = wraps = 0  # characters of text so far, forms and named elements so far
    wide: list[tuple[int, str, int]] = []  # number and name of each such element and the characters in it

    def flush() -> None:
        nonlocal first, blank, linked
        if not blank:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                blocks.append((text, first[1], first[0], linked, sum(map(len, parts))))
        parts.clear()
        first, blank, linked = None, True, 0

    def pop() -> _Open:
        gone = stack.pop()
        if gone.wrap >= 0:
            wide.append((gone.wrap, gone.name, seen - gone.before))
        if gone.name in SCOPES:
            inner.pop()
            scopes[gone.name] -= 1
        else:
            inner[-1][gone.name] -= 1
        if gone.content:
            node = gone.node
            layouts[node] = (layouts[node] * _STEP + gone.layout) & _MASK
            contents[node] = (contents[node] * _STEP + gone.content) & _MASK
            stack[-1].content = (stack[-1].content * _STEP + gone.content) & _MASK
            stack[-1].layout = (stack[-1].layout * _STEP + gone.layout) & _MASK
        return gone

    def close(name: str) -> None:
        if scopes[name] if name in SCOPES else inner[-1].get(name, 0):
            while pop().name != name:
                pass

    def close_any(names: set[str]) -> None:
        # up to the next bound, which may be one of them itself
        while True:
            found = names if stack[-1].name in names else {n for n in names if inner[-1].get(n, 0)}
            if not found:
                return
            while pop().name not in found:
                pass

    way, pos, size = 0, 0, len(page)
    known: dict[tuple[str, str], tuple[int, float, float]] = {}
    while pos < size:
        m = _TOKENS[way].match(page, pos)
        name = m[2]
        if not name:
            start, pos = pos, m.end()
            if page[start] == "<":
                if way < 2 and _BEGINS.match(page, start):
                    way, pos = way + 1, start  # a tag that never ends
                    continue
                if pos - start > 1 and way < 2:
                    continue  # a comment or declaration
            text = page[start:pos]
            solid = not text.isspace()
            weight = min(top.by_tag, top.by_name)
            here = (top.node, weight, articles[top.node])
            if first is not None and here[1:] != first[1:]:  # an inline element that weighs otherwise stands for itself
                flush()
            if first is None or blank and solid:
                first = here
            if solid:
                blank = False
                if top.by_tag:
                    seen += len(text)
                top.layout = (top.layout * _STEP + _TEXT) & _MASK
                top.content = (top.content * _STEP + (xxhash.xxh64_intdigest(" ".join(text.split())) | 1)) & _MASK
            parts.append(text)
            if top.link:
                linked += len(text)
            continue
        pos = m.end()
        name, ending = name.lower(), m[1]
        if ending:
            if name in BLOCK:
                flush()
            close(name)
            top = stack[-1]
            continue
        attributes = m[3]
        found = known.get((name, attributes))
        if found is None:
            label, by_tag, by_name = element(name, attributes)
            found = known[name, attributes] = (xxhash.xxh64_intdigest(label), by_tag, by_name)
        label, by_tag, by_name = found
        if name in BLOCK:
            flush()
            closed = CLOSES.get(name)
            if closed:
                close_any(closed)
            elif name not in ("br", "html", "body", "head") and inner[-1].get("p", 0):
                close_any(_ANY_P)
            top = stack[-1]
        top.layout = (top.layout * _STEP + label) & _MASK
        if name in VOID or name in RAW and attributes.endswith("/"):
            continue
        article = articles[top.node]
        if name == "header" and article < 0:
            by_tag = SURROUNDINGS if by_tag > SURROUNDINGS else by_tag
        path = ((ids[top.node] ^ label) * _STEP + label) & _MASK
        node = place.get(path)
        if node is None:
            node = place[path] = len(ids)
            ids.append(path)
            parents.append(top.node)
            articles.append(node if article < 0 and name in ("article", "main") else article)
            layouts.append(0)
            contents.append(0)
        wrap = -1
        if name == "form" or REMARKS < by_name < 1.0:
            wrap, wraps = wraps, wraps + 1
            if wrap in free:
                by_tag, by_name = 1.0, 1.0
        if articles[node] == node:  # the names of an article and of what is around it say nothing about it
            by_name = 1.0
        elif article >= 0 and by_name == NAMED:  # inside an article a sidebar is as good as an advert
            by_name = min(UNWANTED, top.by_name)
        else:
            by_name = min(by_name, top.by_name)
        top = _Open(name, min(by_tag, top.by_tag), by_name, top.link or name == "a", node, wrap, seen)
        stack.append(top)
        if name in SCOPES:
            inner.append({})
            scopes[name] += 1
        else:
            inner[-1][name] = inner[-1].get(name, 0) + 1
        if name in RAW:
            m = _ENDS[name].search(page, pos)
            pos = m.start() if m else size
    flush()
    while len(stack) > 1:
        pop()
    alone = not any(articles[node] >= 0 for _, _, node, _, _ in blocks)
    most = frozenset(k for k, name, chars in wide if 2 * chars >= seen > 0 and (alone or name == "form")) | free
    if most != free:
        return parse(page, host, low, most)
    layouts[0], contents[0] = stack[0].layout, stack[0].content

    # nodes with text only; where a node has some, so have those around it
    kept = [i for i, c in enumerate(contents) if c]
    new = {i: k for k, i in enumerate(kept)} | {-1: -1}
    inside = sum(chars for _, weight, node, _, chars in blocks if articles[node] >= 0 and weight * WITHIN >= low)
    outside = 1.0 if not inside else OUTSIDE if 2 * inside >= seen else BESIDE
    weights = [weight * (1.0 if articles[node] >= 0 else outside * (LINKS if 2 * links > chars else 1.0)) for _, weight, node, links, chars in blocks]
    of = lambda values: [values[i] for i in kept]
    return Parsed([b[0] for b in blocks], weights, [new[b[2]] for b in blocks], of(ids), [new[p] for p in of(parents)], [new[a] for a in of(articles)], of(layouts), of(contents))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


_COLUMNS = {"url": "string", "texts": "array<string>", "weights": "array<float>", "at": "array<int>", "ids": "array<bigint>", "parents": "array<int>", "articles": "array<int>", "layouts": "array<bigint>", "contents": "array<bigint>"}


def _lists(parts: list[np.ndarray | list], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = [x for p in parts for x in p] if kind == pa.string() else np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *parts])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", low: float = LOW) -> DataFrame:
    """key (as `page`), url, and the fields of `Parsed` as arrays, for every row."""

    def batch_of(keys: pa.Array, urls: list[str | None], found: list[Parsed]) -> pa.RecordBatch:
        ints = lambda name, kind: _lists([np.array(getattr(p, name), kind.to_pandas_dtype()) for p in found], kind)
        hashes = lambda name: _lists([_signed(getattr(p, name)) for p in found], pa.int64())
        columns = [keys, pa.array(urls, pa.string()), _lists([p.texts for p in found], pa.string()), ints("weights", pa.float32()), ints("at", pa.int32()), hashes("ids"), ints("parents", pa.int32()), ints("articles", pa.int32()), hashes("layouts"), hashes("contents")]
        return pa.RecordBatch.from_arrays(columns, ["page", *_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, urls = batch.column(0), batch.column(1).to_pylist()
            found, begin, size = [], 0, 0
            for i, page in enumerate(batch.column(2)):
                text = page.as_py() or ""
                found.append(parse(text, host_of(urls[i]), low))
                size += len(text)
                if size > OUT_BYTES:
                    yield batch_of(keys.slice(begin, len(found)), urls[begin : i + 1], found)
                    found, begin, size = [], i + 1, 0
            yield batch_of(keys.slice(begin, len(found)), urls[begin:], found)

    kinds = ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())
    return pages.select(key, url, html).mapInArrow(run, f"page {pages.schema[key].dataType.simpleString()}, {kinds}")


def observations(pages: DataFrame) -> DataFrame:
    """node, layout, content: one row for each node of each page in `parsed`."""
    return pages.select(F.explode(F.arrays_zip("ids", "layouts", "contents")).alias("o")).select(F.col("o.ids").alias("node"), F.col("o.layouts").alias("layout"), F.col("o.contents").alias("content"))


def style_tree(seen: DataFrame, min_pages: int = MIN_PAGES, share: float = PRESENTATION_SHARE, doubt: float = DOUBT) -> DataFrame:
    """node, pages, importance of every merged node that `min_pages` pages or more have; UNKNOWN counts as the importance of `doubt` pages more."""
    both = seen.select("node", F.explode(F.array(F.struct(F.lit(share).alias("w"), F.lit(0).alias("kind"), F.col("layout").alias("value")), F.struct(F.lit(1 - share).alias("w"), F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("x"))
    counts = both.groupBy("node", "x.kind", "x.w", "x.value").agg(F.count(F.lit(1)).alias("c"))
    # entropy over the most that so many pages can have, from 0 (always the same) to 1 (always different)
    sums = counts.groupBy("node").agg((F.sum("c") / 2).cast("long").alias("pages"), F.sum(F.col("w") * F.col("c") * F.log("c")).alias("s"))
    value = (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")
    return sums.filter(F.col("pages") >= max(2, min_pages)).select("node", "pages", ((F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) * F.col("pages") + UNKNOWN * doubt) / (F.col("pages") + doubt)).alias("importance"))


def branches(importance: list[float], parents: list[int], articles: list[int], low: float = LOW) -> list[float]:
    """The importance of the branch that ends at each node of a page."""
    out: list[float] = []
    for i, (value, parent, article) in enumerate(zip(importance, parents, articles, strict=True)):
        if article < 0:
            out.append(min(value, out[parent] if parent >= 0 else 1.0))
        elif article == i or importance[article] < low:
            out.append(WITHIN)
        else:
            out.append(min(out[parent], WITHIN * value / importance[article]))
    return out


def kept_text(texts: list[str], weights: list[float], at: list[int], branch: list[float], low: float = LOW) -> str:
    return " ".join(t for t, w, n in zip(texts, weights, at, strict=True) if w * branch[n] >= low - 1e-6)


def main_text(page: str | None, scores: Mapping[int, float] | None = None, low: float = LOW, host: str = "") -> str:
    """The main text of one page, with the importances of nodes (UNKNOWN where none is given)."""
    p = parse(page or "", host, low)
    return kept_text(p.texts, p.weights, p.at, branches([(scores or {}).get(i, UNKNOWN) for i in p.ids], p.parents, p.articles, low), low)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", low: float = LOW, max_nodes: int = MAX_BROADCAST_NODES) -> DataFrame:
    """key, url, text for every row of `pages`."""
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/site-tree-{uuid.uuid4().hex}"

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    rows = put("parsed", parsed(pages, key, url, html, low).withColumn("row", F.monotonically_increasing_id()))
    tree = put("tree", style_tree(observations(rows)))
    found = tree.agg(F.count(F.lit(1)), F.sum("pages")).first()
    # nodes with more than one part in max_nodes of all rows: fewer than max_nodes
    many = tree if found[0] <= max_nodes else tree.filter(F.col("pages") * max_nodes > found[1])
    table = many.select("node", F.col("importance").cast("float")).toArrow()
    order = np.argsort(table["node"].to_numpy())
    shared = spark.sparkContext.broadcast((table["node"].to_numpy()[order], table["importance"].to_numpy()[order]))
    columns = ["page", "url", "texts", "weights", "at", "ids", "parents", "articles"]
    if found[0] > max_nodes:
        few = tree.filter(F.col("pages") * max_nodes <= found[1]).select("node", F.col("importance").cast("float").alias("importance"))
        own = rows.select("row", F.explode("ids").alias("node")).join(few, "node").groupBy("row").agg(F.collect_list(F.struct("node", "importance")).alias("more"))
        rows = rows.select("row", *columns).join(own, "row", "left").select(*columns, "more")
    else:
        rows = rows.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, values = shared.value
        for batch in batches:
            lists = batch.column(5)
            ids = np.asarray(lists.flatten())
            importance = np.full(len(ids), UNKNOWN)
            if len(nodes):
                place = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
                importance = np.where(nodes[place] == ids, values[place], UNKNOWN)
            ends = np.cumsum([0, *np.asarray(lists.value_lengths().fill_null(0))]).tolist()
            texts = []
            more = batch.column(8) if batch.num_columns > 8 else None
            for i in range(batch.num_rows):
                own = importance[ends[i] : ends[i + 1]].tolist()
                if more is not None and more[i].is_valid:
                    by_node = {x["node"]: x["importance"] for x in more[i].as_py()}
                    own = [by_node.get(n, v) for n, v in zip(lists[i].as_py(), own, strict=True)]
                text, weights, at, parents, articles = (batch.column(c)[i].as_py() for c in (2, 3, 4, 6, 7))
                texts.append(kept_text(text, weights, at, branches(own, parents, articles, low), low))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [key, url, "text"])

    return rows.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` string, text string")
