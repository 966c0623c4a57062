"""Pages: blocks of a page, site boilerplate, link frontiers, page registries, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import urls
from lectern.functions.texts import has_contacts
from lectern.operators.documents import with_sections
from lectern.operators.page_blocks import typed_blocks

#: A list of two items, the second a price in lei.
PRICE_LIST = r"(?is)<ul\b[^>]*>\s*<li\b[^>]*>\s*([^<]*?)\s*</li>\s*<li\b[^>]*>\s*(\d[\d\s.,]*?)\s*(lei|mdl)\.?\s*</li>\s*</ul>"
#: Rules of robots that may be broadcast.
MOST_RULES = 100_000
BOILERPLATE_SHARE, MIN_PAGES, MIN_PAGE_CHARS = 0.30, 3, 200


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, id, type, level, text of the typed blocks of each page, in order."""
    return typed_blocks(pages, key, html, keep).select(key, *keep, "id", "type", "level", "text")


def repeated_blocks(rows: DataFrame, site: str = "site", page: str = "page_id", share: float = BOILERPLATE_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """site, key, n_pages, site_pages, dropped: on how many pages of a site each text stands, once a page.

    Two grouped counts; a site of any size is spread by the text.
    """
    keyed = rows.select(site, page, F.lower(F.trim("text")).alias("key")).distinct()
    counts = keyed.groupBy(site, "key").agg(F.count(F.lit(1)).alias("n_pages"))
    pages = rows.select(site, page).distinct().groupBy(site).agg(F.count(F.lit(1)).alias("site_pages"))
    both = counts.join(pages, site)
    drop = (F.col("site_pages") >= min_pages) & (F.col("n_pages") > share * F.col("site_pages")) & ~has_contacts(F.col("key"))
    return both.withColumn("dropped", drop)


def without_repeated(rows: DataFrame, repeated: DataFrame, site: str = "site") -> DataFrame:
    """Blocks without those that a site repeats; a block with a phone or an e-mail stays."""
    poor = repeated.filter("dropped").select(site, "key")
    return rows.withColumn("key", F.lower(F.trim("text"))).join(poor, [site, "key"], "left_anti").drop("key")


def page_documents(rows: DataFrame, page: str = "page_id", least: int = MIN_PAGE_CHARS) -> DataFrame:
    """page, title (the first heading of level 1), n_blocks, n_chars and empty (too little text is left)."""
    title = F.min(F.when((F.col("type") == "heading") & (F.col("level") == 1), F.struct("id", "text")))["text"]
    chars = F.sum(F.length("text")).cast("long")
    return rows.groupBy(page).agg(title.alias("title"), F.count(F.lit(1)).alias("n_blocks"), chars.alias("n_chars"), (chars < least).alias("empty"))


def sectioned(rows: DataFrame, page: str = "page_id") -> DataFrame:
    return with_sections(rows, page)


def frontier(pages: DataFrame, seen: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """link, found_on of one step of a crawl: canonical targets not seen yet, assets and traps left out, found on the least address."""
    found = pages.select(F.col(url).alias("found_on"), F.explode(urls.links(F.col(html))).alias("_l"))
    targets = found.select("found_on", urls.canonical(urls.resolved(F.col("_l"), F.col("found_on"))).alias("link"))
    fresh = targets.filter(F.col("link").isNotNull() & ~urls.is_skipped(F.col("link"))).withColumn("_k", urls.key(F.col("link")))
    known = seen.select(urls.key(F.col(url)).alias("_k")).distinct()
    return fresh.join(known, "_k", "left_anti").groupBy("_k").agg(F.min(F.struct("found_on", "link")).alias("_m")).select(F.col("_m.link").alias("link"), F.col("_m.found_on").alias("found_on"))


def fingerprint(text: Column) -> Column:
    """Hash of a text without regard to case and white space."""
    return F.sha1(F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")))


def changes(before: DataFrame, after: DataFrame, key: str = "url", value: str = "hash") -> DataFrame:
    """key, change: new, gone, changed or same, by a full outer join of two snapshots."""
    b = before.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    kind = F.when(F.col("_in_b").isNull(), "new").when(F.col("_in_a").isNull(), "gone").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, kind.alias("change"))


def redesigned(diff: DataFrame, site: Column, share: float = 0.6, least: int = 5) -> DataFrame:
    """site, pages, changed, redesign: so many pages changed that the site's frame, not its content, is new."""
    counted = diff.filter("change in ('same', 'changed')").groupBy(site.alias("site")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("change") == "changed").alias("changed"))
    return counted.withColumn("redesign", (F.col("pages") >= least) & (F.col("changed") >= share * F.col("pages")))


def newest_copy(pages: DataFrame, url: str, fetched: str, *columns: str) -> DataFrame:
    """The newest copy of each page over all forms of its address."""
    row = F.max_by(F.struct(url, fetched, *columns), F.struct(F.col(fetched), F.col(url)))
    return pages.groupBy(urls.key(F.col(url)).alias("url_key")).agg(row.alias("_r")).select("url_key", "_r.*")


def publication_date(html: Column) -> Column:
    """The first ISO date among the usual meta tags and time elements."""
    names = ["article:published_time", "datePublished", "dc.date", "date", "pubdate"]
    forms = [rf"""(?is)<meta\b[^>]*(?:property|name|itemprop)\s*=\s*["']{n}["'][^>]*content\s*=\s*["'](\d{{4}}-\d{{2}}-\d{{2}})""" for n in names]
    forms += [rf"""(?is)<meta\b[^>]*content\s*=\s*["'](\d{{4}}-\d{{2}}-\d{{2}})[^>]*(?:property|name|itemprop)\s*=\s*["']{n}["']""" for n in names]
    forms.append(r"""(?is)<time\b[^>]*datetime\s*=\s*["'](\d{4}-\d{2}-\d{2})""")
    return F.coalesce(*[F.nullif(F.regexp_extract(html, f, 1), F.lit("")) for f in forms])


def sanitised(html: Column) -> Column:
    """A page without active content: scripts, frames, forms, event handlers and addresses that run code."""
    out = html
    for tag in ("script", "style", "iframe", "object", "embed", "form", "noscript", "template"):
        out = F.regexp_replace(F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", ""), rf"(?i)</?{tag}\b[^>]*>", "")
    out = F.regexp_replace(out, r"""(?i)\son[a-z]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "")
    return F.regexp_replace(out, r"""(?i)(href|src|action)\s*=\s*(["']?)\s*(?:javascript|vbscript|data):[^"'\s>]*\2""", "$1=$2#$2")


def site_counts(pages: DataFrame, site: Column) -> DataFrame:
    """site, pages, distinct addresses, pages with a query, with http, and the largest page: one pass with conditional aggregates."""
    url = F.col("url")
    return pages.groupBy(site.alias("site")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.countDistinct(urls.key(url)).alias("addresses"),
        F.count_if(urls.part(url, "query") != "").alias("with_query"),
        F.count_if(urls.part(url, "scheme") == "http").alias("insecure"),
        F.max(F.length("html")).cast("long").alias("largest"),
    )


def ranked_pages(pages: DataFrame, site: str, order: list[Column | str], n: int) -> DataFrame:
    """The first n pages of each site, as its key pages."""
    w = Window.partitionBy(site).orderBy(*order)
    return pages.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with `allowed` and `delay` by the rules of their host: host, prefix, allow, delay. The longest prefix of the path and query counts, and
    allowing on a tie; a page without a rule is allowed.

    Prefixes of a path as long as a host's rules make the join an equality on host and prefix, so a host with any share of all pages is dealt by path.
    """
    target = F.concat(urls.part(F.col(url), "path"), F.when(urls.part(F.col(url), "query") == "", "").otherwise(F.concat(F.lit("?"), urls.part(F.col(url), "query"))))
    lengths = rules.groupBy("host").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("_lengths"), F.max("delay").alias("delay"))
    addresses = pages.select(url).distinct().select(url, urls.host(F.col(url)).alias("host"), F.when(target == "", "/").otherwise(target).alias("_t"))
    cut = addresses.join(F.broadcast(lengths) if rules.limit(MOST_RULES + 1).count() <= MOST_RULES else lengths, "host", "left")
    keys = cut.select(url, "host", F.explode(F.filter("_lengths", lambda n: n <= F.length("_t"))).alias("_n"), "_t").select(url, "host", F.substring("_t", F.lit(1), F.col("_n")).alias("prefix"), "_n")
    best = keys.join(rules.select("host", "prefix", "allow"), ["host", "prefix"]).groupBy(url).agg(F.max(F.struct("_n", "allow")).alias("_best"))
    verdict = cut.select(url, "delay").join(best, url, "left").select(url, F.coalesce("_best.allow", F.lit(True)).alias("allowed"), "delay")
    return pages.join(verdict, url, "left")


def embedded_records(html: Column) -> Column:
    """Records that a page carries in hidden text areas: array<map<string,string>> of those with a title; nested values are JSON texts."""
    islands = F.regexp_extract_all(html, F.lit(r"(?is)<textarea\b(?=[^>]*\shidden\b)[^>]*>(.*?)</textarea\s*>"), F.lit(1))
    plain = lambda t: F.replace(F.replace(F.replace(F.replace(t, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    records = F.flatten(F.transform(islands, lambda t: F.coalesce(F.from_json(plain(t), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))))
    return F.filter(records, lambda r: r.isNotNull() & (F.trim(F.coalesce(F.try_element_at(r, F.lit("title")), F.lit(""))) != ""))


def record_blocks(record: Column) -> Column:
    """Blocks of an embedded record: array<struct<type,level,text>>: its title, its texts without tags, fee and term where no text tells the fees, its attachments."""
    squashed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^ | $", "")
    block = lambda kind, text, level=None: F.struct(F.lit(kind).alias("type"), F.lit(level).cast("int").alias("level"), text.alias("text"))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    value = lambda k: F.try_element_at(record, F.lit(k))
    texts = F.filter(F.map_entries(record), lambda e: e["key"].endswith("_html") & filled(e["value"]))
    pieces = F.flatten(F.transform(texts, lambda e: F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(e["value"], r"(?i)<(?:br|/?p|/?li|/?ul|/?ol|/?div)\b[^>]*>", "\x01"), "<[^>]*>", ""), "\x01"), squashed), lambda t: t != "")))
    short = F.array(*[F.when(filled(value(k)) & ~filled(value("fees_html")), block("paragraph", F.concat(F.lit(label + ": "), squashed(value(k))))) for k, label in (("fee", "Tarif"), ("term", "Termen"))])
    attached = F.coalesce(F.from_json(value("appendix"), "array<struct<title:string,url:string>>"), F.array().cast("array<struct<title:string,url:string>>"))
    links = F.transform(F.filter(attached, lambda a: filled(a["url"])), lambda a: block("list_item", F.concat(F.when(filled(a["title"]), a["title"]).otherwise("Anexă"), F.lit(": "), a["url"])))
    return F.concat(F.array(block("heading", squashed(value("title")), 2)), F.transform(pieces, lambda t: block("paragraph", t)), F.filter(short, lambda b: b.isNotNull()), links)


def with_price_lines(html: Column) -> Column:
    """A page whose lists of a label and a price are one labelled paragraph each."""
    return F.regexp_replace(html, PRICE_LIST, "<p>$1: $2 $3</p>")


def with_toggle_headings(html: Column) -> Column:
    """A page whose toggle titles are headings."""
    return F.regexp_replace(html, r"(?is)<summary\b[^>]*>(.*?)</summary\s*>", "<h3>$1</h3>")
