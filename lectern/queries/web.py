"""Pages, links and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import urls
from lectern.operators import page_blocks, ranking, web
from lectern.operators.page_blocks import typed_blocks
from lectern.registry import query
from lectern.session import table

_P = r"'^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?)?([^?#]*)(?:\?([^#]*))?'"
_part = lambda n: f"regexp_extract(url, {_P}, {n})"
_KEY = f"regexp_replace(lower({_part(2)}), '^www\\.', '') || CASE WHEN {_part(3)} = '' THEN '' ELSE ':' || {_part(3)} END || CASE WHEN rtrim({_part(4)}, '/') = '' THEN '/' ELSE rtrim({_part(4)}, '/') END || CASE WHEN {_part(5)} = '' THEN '' ELSE '?' || {_part(5)} END"
_HOST = f"lower({_part(2)})"


#: The references of the given pages, for the SQL.
_REFERENCES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


_KINDS = {**{h: ("heading", n) for h, n in page_blocks.HEADINGS.items()}, "li": ("list_item", None)}


def _blocks_sql() -> str:
    """Blocks of pages without tables and toggles, by patterns."""
    body = r"regexp_replace(html, '(?is)<!--.*?-->|<head\b.*?</head\s*>', '', 'g')"
    for t in sorted(page_blocks.DROPPED - {'head'}):
        body = rf"regexp_replace({body}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', chr(1), 'g')"
    body = rf"regexp_replace({body}, '(?i)<({'|'.join(_KINDS)})\b[^>]*>', chr(1) || '\1' || chr(2), 'g')"
    body = rf"regexp_replace({body}, '(?i)</?(?:{'|'.join(sorted(page_blocks.BREAKS))})\b[^>]*>', chr(1), 'g')"
    body = rf"regexp_replace({body}, '<[a-zA-Z/!][^>]*>', '', 'g')"
    for name, char in _REFERENCES.items():
        body = f"replace({body}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    kind = "CASE " + " ".join(f"WHEN tag = '{t}' THEN '{k}'" for t, (k, _) in _KINDS.items()) + " ELSE 'paragraph' END"
    level = "CASE " + " ".join(f"WHEN tag = '{t}' THEN {n}" for t, (_, n) in _KINDS.items() if n) + " END"
    return rf"""raw AS (SELECT page_id, url, string_split({body}, chr(1)) AS ps FROM pages),
pieces AS (SELECT page_id, url, i, CASE WHEN contains(ps[i], chr(2)) THEN lower(split_part(ps[i], chr(2), 1)) ELSE '' END AS tag,
  regexp_replace(regexp_replace(CASE WHEN contains(ps[i], chr(2)) THEN substr(ps[i], strpos(ps[i], chr(2)) + 1) ELSE ps[i] END, '\s+', ' ', 'g'), '^ | $', '', 'g') AS text
  FROM raw, LATERAL unnest(range(1, len(ps) + 1)) AS u(i)),
blocks AS (SELECT page_id, url, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS id, {kind} AS type, ({level})::INT AS level, text FROM pieces WHERE text <> '')"""


_BLOCKS = _blocks_sql()


def _with_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return web.blocks(pages.withColumn("site", urls.bare_host(urls.host(F.col("url")))), keep=("site",))


@query(f"WITH {_BLOCKS} SELECT page_id, id, type, level, sha1(text) AS hash, length(text)::INT AS n FROM blocks")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = web.blocks(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "id", "type", "level", F.sha1("text").alias("hash"), F.length("text").alias("n"))


@query("""
SELECT o_custkey, count(*)::INT * 2 AS n_rows, md5('| Order | State | State |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' & co | ' || o_orderpriority || ' |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderkey % 7 || ' |  |', chr(10) ORDER BY o_orderkey)) AS hash FROM orders GROUP BY o_custkey
""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with a table of the orders of each customer, whose cells span rows and columns, as a typed block."""
    row = F.concat(F.lit("<tr><td rowspan=2>"), "o_orderkey", F.lit("<td>"), "o_orderstatus", F.lit(" &amp; co</td><td>\n"), "o_orderpriority", F.lit("</td></tr><tr><td>"), F.col("o_orderkey") % 7, F.lit("</td><td></td></tr>"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    pages = o.select("o_custkey", F.concat(F.lit("<nav><table><tr><td>menu</table></nav><h1>Orders</h1><table><tr><th>Order</th><th colspan='2'>State</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    found = typed_blocks(pages, "o_custkey").filter("type = 'table'")
    return found.select("o_custkey", F.size("rows").alias("n_rows"), F.md5("text").alias("hash"))


_SITE = f"regexp_replace({_HOST}, '^www\\.', '')"


@query(rf"""
WITH {_BLOCKS}, k AS (SELECT DISTINCT {_SITE} AS site, page_id, lower(trim(text)) AS key FROM blocks),
c AS (SELECT site, key, count(*) AS n_pages FROM k GROUP BY ALL), p AS (SELECT site, count(DISTINCT page_id) AS site_pages FROM k GROUP BY site)
SELECT site, sha1(key) AS hash, n_pages, site_pages, site_pages >= 3 AND n_pages > 0.30 * site_pages
  AND NOT regexp_matches(key, '(?:(?:\+373|0)\s*\(?\d{{2,3}}\)?[\s.-]*\d{{2,3}}[\s.-]*\d{{2,4}})') AND NOT regexp_matches(key, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') AS dropped
FROM c JOIN p USING (site)
""")
def boilerplate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = web.repeated_blocks(_with_site(spark, sf_dir))
    return found.select("site", F.sha1("key").alias("hash"), "n_pages", "site_pages", "dropped")


@query(f"""
WITH {_BLOCKS}, t AS (SELECT page_id, text AS title FROM blocks WHERE type = 'heading' AND level = 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY id) = 1)
SELECT page_id, any_value(title) AS title, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars, sum(length(text)) < 200 AS empty FROM blocks LEFT JOIN t USING (page_id) GROUP BY page_id
""")
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.page_documents(web.blocks(table(spark, sf_dir, "pages")))


@query(f"""
WITH {_BLOCKS}, h AS (SELECT page_id, id, text, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, type FROM blocks)
SELECT page_id, id, CASE WHEN type = 'heading' OR above IS NULL THEN '' ELSE above END AS section FROM h
""")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the given table have one level of headings, so a section is the heading above."""
    rows = web.sectioned(web.blocks(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "id", F.array_join("section", " › ").alias("section"))


@query(f"SELECT {_KEY} AS url_key, count(*) AS n, min(url) AS url FROM pages GROUP BY 1")
def url_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(urls.key(F.col("url")).alias("url_key")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"))


@query(f"""
WITH p AS (SELECT page_id, {_part(1)} AS scheme, {_HOST} AS host, {_part(3)} AS port, regexp_replace({_part(4)}, '/{{2,}}', '/', 'g') AS path,
  list_sort(list_transform(list_filter(string_split({_part(5)}, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '(?i)^(utm_\\w+|fbclid|gclid|yclid|_ga|mc_cid|mc_eid)$')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS q FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS url FROM p
""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


@query(rf"""
SELECT page_id, lower(regexp_extract({_part(4)}, '[^/.][^/]*?(\.[^./]*)$', 1)) AS extension,
  lower(regexp_extract({_part(4)}, '[^/.][^/]*?(\.[^./]*)$', 1)) IN ('.pdf', '.doc', '.docx', '.odt', '.rtf', '.xls', '.xlsx', '.ods', '.csv', '.ppt', '.pptx', '.odp', '.zip', '.rar', '.7z') AS document,
  regexp_matches(url, '(?i)/wp-(admin|login|json)|/xmlrpc|/feed/?$|/cdn-cgi/|/(login|logout|register)\b|/tag/|/author/|/calendar|/print/|[?&](s|q|search|replytocom|print|share|action|ical|month|year|day|date|tribe-bar-date|eventDisplay)=') AS skipped,
  {_part(4)} = '/en' OR starts_with({_part(4)}, '/en/') AS english
FROM pages
""")
def doc_link_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.extension(url).alias("extension"), urls.is_document(url).alias("document"), urls.is_skipped(url).alias("skipped"), urls.under_prefix(urls.part(url, "path"), F.lit("/en/")).alias("english"))


@query(f"SELECT {_SITE} AS site, count(*) AS pages, count(DISTINCT {_KEY}) AS addresses, count(*) FILTER ({_part(5)} <> '') AS with_query, count(*) FILTER ({_part(1)} = 'http') AS insecure, max(length(html))::BIGINT AS largest FROM pages GROUP BY 1")
def page_registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.site_counts(table(spark, sf_dir, "pages"), urls.bare_host(urls.host(F.col("url"))))


@query(rf"""
WITH l AS (SELECT url AS found_on, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"''#]+)', 1))) AS l FROM pages),
a AS (SELECT found_on, regexp_extract(found_on, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(found_on, '^[a-z]+://([^/?#:]*)', 1)) || l AS link FROM l WHERE starts_with(l, '/')),
k AS (SELECT *, regexp_replace(regexp_extract(link, '^[a-z]+://(.*)$', 1), '^www\.', '') AS k FROM a WHERE NOT regexp_matches(link, '(?i)/(login|logout|register)\b|/calendar|/tag/|/print/'))
SELECT count(DISTINCT rtrim(k, '/')) AS links FROM k
""")
def frontier_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets found on all pages and on none before: one step of a crawl."""
    pages = table(spark, sf_dir, "pages")
    return web.frontier(pages, pages.limit(0)).agg(F.count(F.lit(1)).alias("links"))


@query(rf"SELECT {_KEY} AS url_key, arg_max(page_id, page_id) AS page_id FROM pages GROUP BY 1")
def newest_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url", "page_id")
    return web.newest_copy(pages, "url", "page_id").select("url_key", "page_id")


@query(f"""
WITH b AS (SELECT url, arg_max(sha1(html), page_id) AS h FROM pages WHERE page_id % 3 <> 0 GROUP BY url),
a AS (SELECT url, arg_max(sha1(CASE WHEN page_id % 4 = 0 THEN html || 'x' ELSE html END), page_id) AS h FROM pages WHERE page_id % 5 <> 0 GROUP BY url)
SELECT coalesce(a.url, b.url) AS url, CASE WHEN b.url IS NULL THEN 'new' WHEN a.url IS NULL THEN 'gone' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.url = b.url
""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots derived from the pages, compared."""
    pages = table(spark, sf_dir, "pages")
    before = pages.filter("page_id % 3 <> 0").groupBy("url").agg(F.max_by(F.sha1("html"), "page_id").alias("hash"))
    later = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    after = pages.filter("page_id % 5 <> 0").groupBy("url").agg(F.max_by(F.sha1(later), "page_id").alias("hash"))
    return web.changes(before, after)


@query(f"SELECT site, page_id, place FROM (SELECT {_SITE} AS site, page_id, row_number() OVER (PARTITION BY {_SITE} ORDER BY length({_part(4)}), url, page_id)::INT AS place FROM pages) WHERE place <= 4")
def key_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", urls.bare_host(urls.host(F.col("url"))).alias("site"))
    return web.ranked_pages(pages, "site", [F.length(urls.part(F.col("url"), "path")), "url", "page_id"], 4).select("site", "page_id", "place")


@query(f"SELECT site, page_id FROM (SELECT {_SITE} AS site, page_id, row_number() OVER (PARTITION BY {_SITE} ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def first_page_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.bare_host(urls.host(F.col("url"))).alias("site"))
    return ranking.first_wins(pages, F.col("site"), "page_id").select("site", "page_id")
