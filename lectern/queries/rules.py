"""Rules and small functions over the given tables: predicates, addresses, times, titles, tables, embedded records, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import acts, texts, urls
from lectern.operators import analytics, answers, contacts, corpus, documents, titles, web
from lectern.queries.analytics import _PRICE_ROWS, PRICES
from lectern.queries.retrieval import _LINES
from lectern.registry import query
from lectern.session import table


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '\\d{{4}}')) AS dated, count(*) FILTER (starts_with(line, 'The') OR starts_with(line, 'De')) AS begins FROM lines GROUP BY doc_id")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a run of four digits, and lines that begin with one of some prefixes."""
    rows = corpus.lines(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(corpus.dated(F.col("line"))).alias("dated"), F.count_if(corpus.begins_with_any(F.col("line"), ["The", "De"])).alias("begins"))


@query("""
SELECT conv_id, count(*) FILTER (role = 'user') AS asked, bool_or(role = 'user' AND (conv_id % 3 <> 0 OR turn > 0)) AS rewrite, conv_id % 4 = 1 OR (conv_id % 4 <> 2 AND max(turn) > 2) AS second_pass,
  count(*) FILTER (role = 'assistant') > 0 AND conv_id % 4 = 0 AND count(*) FILTER (role = 'user') > 1 AS good FROM conversations GROUP BY conv_id
""")
def answer_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conversations need another wording, another search, and which are good."""
    k, user = F.col("conv_id"), F.col("role") == "user"
    lang = F.when(k % 3 == 0, "ro").otherwise("en")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(user).alias("asked"), F.bool_or(user & answers.needs_rewrite(lang, F.col("turn"))).alias("rewrite"), F.max("turn").alias("_last"), F.count_if(F.col("role") == "assistant").alias("_said")
    )
    verdict = F.when(k % 4 == 1, "partial").when(k % 4 == 2, "refused").otherwise("answered")
    status = F.when(F.col("_said") > 0, "answered").otherwise("not_found")
    return c.select("conv_id", "asked", "rewrite", answers.needs_second_pass(verdict, F.col("_last") > 2).alias("second_pass"), answers.good_answer(status, k % 4 == 0, F.col("asked") - 1).alias("good"))


@query("""
WITH o AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS urls FROM lineitem GROUP BY 1)
SELECT l_orderkey, NOT list_contains(urls, 3) AS lacks_third FROM o
""")
def unlisted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose list of lines does not hold the third: an anti-containment test."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("urls"))
    return o.select("l_orderkey", (~F.array_contains("urls", 3)).alias("lacks_third"))


_KINDS = ["https://drive.google.com/file/d/{}/view", "https://docs.google.com/spreadsheets/d/{}/edit#gid=0", "https://drive.google.com/open?id={}", "http://files.example/{}.PDF?x=1", "https://docs.google.com/document/d/{}"]


@query("""
SELECT o_orderkey, ['https://drive.google.com/uc?export=download&id=a-' || o_orderkey, 'https://docs.google.com/spreadsheets/d/a-' || o_orderkey || '/export?format=xlsx', 'https://drive.google.com/uc?export=download&id=a-' || o_orderkey,
  'http://files.example/a-' || o_orderkey || '.PDF?x=1', 'https://docs.google.com/document/d/a-' || o_orderkey || '/export?format=docx'][(o_orderkey % 5 + 1)::INT] AS download,
  CASE WHEN o_orderkey % 5 = 3 THEN '.pdf' WHEN o_custkey % 3 = 0 THEN '.xlsx' WHEN o_custkey % 3 = 1 THEN '.csv' ELSE '' END AS extension FROM orders
""")
def download_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to files written from orders: what to download, and the extension of what comes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    url = F.lit("")
    for i, form in enumerate(_KINDS):
        a, b = form.split("{}")
        url = F.when(k % 5 == i, F.concat(F.lit(a + "a-"), k, F.lit(b))).otherwise(url)
    sent = F.when(c % 3 == 0, F.concat(F.lit("attachment; filename*=UTF-8''raport%20"), k, F.lit(".XLSX")))
    kind = F.when(c % 3 == 1, "text/csv").otherwise("application/octet-stream")
    return table(spark, sf_dir, "orders").select("o_orderkey", urls.direct_download(url).alias("download"), urls.file_extension(url, sent, kind).alias("extension"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS s, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q, url FROM pages)
SELECT page_id, CASE WHEN lower(s) IN ('http', 'https') AND contains(lower(regexp_replace(h, ':.*$', '')), '.') THEN lower(s) || '://' || lower(h) || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS entered,
  CASE WHEN page_id % 4 <> 0 THEN CASE WHEN path IN ('', '/') THEN 4 ELSE 2 END END::INT AS depth, regexp_replace(lower(regexp_replace(h, ':.*$', '')), '^www\\.', '') AS site FROM p
""".replace("\\\\", "\\"))
def entered_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as a user would enter them, with the site and depth of a crawl."""
    url = F.col("url")
    limits = urls.crawl_limits(url, F.when(F.col("page_id") % 4 == 0, "document").otherwise("site"))
    return table(spark, sf_dir, "pages").select("page_id", urls.entered(url).alias("entered"), limits["depth"].alias("depth"), urls.bare_host(urls.host(url)).alias("site"))


@query(r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS t FROM pages),
r AS (SELECT DISTINCT host, '/' AS prefix, length(host) % 2 = 0 AS allow, (length(host) % 5)::DOUBLE AS delay FROM p UNION SELECT DISTINCT host, substr(t, 1, 3), length(t) % 3 > 0, (length(host) % 5)::DOUBLE FROM p WHERE page_id % 2 = 0 AND length(t) >= 3),
o AS (SELECT host, prefix, bool_or(allow) AS allow, any_value(delay) AS delay FROM r GROUP BY host, prefix),
m AS (SELECT page_id, arg_max(allow, length(prefix)) AS allow FROM p JOIN o ON p.host = o.host AND starts_with(CASE WHEN t = '' THEN '/' ELSE t END, prefix) GROUP BY page_id)
SELECT p.page_id, coalesce(m.allow, true) AS allowed, (length(host) % 5)::DOUBLE AS delay FROM p LEFT JOIN m ON m.page_id = p.page_id
""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by rules of robots made from their hosts and paths."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, target = urls.host(F.col("url")), F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    delay = (F.length(host) % 5).cast("double").alias("delay")
    whole = pages.select(host.alias("host"), F.lit("/").alias("prefix"), (F.length(host) % 2 == 0).alias("allow"), delay)
    parts = pages.filter((F.col("page_id") % 2 == 0) & (F.length(target) >= 3)).select(host.alias("host"), F.substring(target, 1, 3).alias("prefix"), (F.length(target) % 3 > 0).alias("allow"), delay)
    rules = whole.unionByName(parts).groupBy("host", "prefix").agg(F.bool_or("allow").alias("allow"), F.first("delay").alias("delay"))
    return web.allowed(pages, rules).select("page_id", "allowed", "delay")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE strftime(date_trunc('second', ts) - CASE WHEN event_id % 4 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS shown FROM events
""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in four forms, read and shown in one; the fourth form is none."""
    form = F.get(F.array(F.lit("yyyy-MM-dd'T'HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd'T'HH:mm:ss"), F.lit("dd.MM.yyyy")), 0)
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, base).when(k == 1, F.concat(base, F.lit("+0200"))).when(k == 2, F.concat(F.replace(base, F.lit("T"), F.lit(" ")), F.lit("Z"))).otherwise(F.date_format("ts", "dd.MM.yyyy"))
    del form
    return table(spark, sf_dir, "events").select("event_id", texts.shown_time(texts.parsed_time(text)).alias("shown"))


@query("""
SELECT user_id, arg_max('done f' || event_id || '.pdf', (ts, event_id)) AS item FROM (SELECT * FROM events WHERE event_id % 3 <> 0) GROUP BY user_id
UNION ALL SELECT user_id, NULL FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 3 <> 0) = 0
""")
def log_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's log was on last, from lines written for events; every third line names no item."""
    line = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("["), "event_id", F.lit("/9] done (ocr) raw/ab/f"), "event_id", F.lit(".pdf/ 3.2s"))).otherwise("pages: 4")
    logs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("l")))), lambda x: x["l"]).alias("log"))
    return logs.select("user_id", texts.current_item(F.col("log")).alias("item"))


@query("""
SELECT c_custkey, c_custkey % 3 = 0 AS copied FROM customer
""")
def copied_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses claimed for customers against evidence with other accents: every third is borne out; others differ in a number or a word."""
    k = F.col("c_custkey")
    value = F.concat(F.lit("bd. Ștefan cel Mare "), k, F.lit(", "), "c_name")
    shown = F.concat(F.lit("Bd. STEFAN cel mare, nr. "), F.when(k % 3 == 1, k + 1).otherwise(k), F.lit(" "), F.when(k % 3 == 2, F.lit("alt nume")).otherwise(F.col("c_name")))
    # names hold their number, so the number is told apart by a mark
    value, shown = (F.regexp_replace(x, "Customer#0*", "Clientul ") for x in (value, shown))
    plain = lambda x: F.regexp_replace(x, r"Clientul (\d+)", "Clientul")
    return table(spark, sf_dir, "customer").select("c_custkey", acts.copied_from(plain(value), F.array(plain(shown))).alias("copied"))


@query("SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without accents, in lower case."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.folded(F.col("text")).alias("folded"))


@query(f"""
WITH m AS (SELECT event_id, event_type || ['', '-2024-05', 'x', ':free'][(event_id % 4 + 1)::INT] AS model, (event_id % 50)::BIGINT AS n FROM events), prices(name, pin, pout) AS (VALUES {_PRICE_ROWS}),
k AS (SELECT DISTINCT model FROM m), p AS (SELECT model, arg_max(pin, length(name)) AS pin, arg_max(pout, length(name)) AS pout FROM k JOIN prices ON starts_with(model, name) GROUP BY model)
SELECT m.model, count(*) AS calls, round(100 * sum((n * pin + n * pout) / 1000000) / count(*), 9) AS per_hundred, round(100 * avg((n > 25)::INT), 0)::INT AS long_share FROM m LEFT JOIN p ON p.model = m.model GROUP BY m.model
""")
def cost_per_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of a hundred calls of each model by the longest listed name it begins with, and the share of long ones."""
    model = F.concat("event_type", F.get(F.array(*map(F.lit, ["", "-2024-05", "x", ":free"])), (F.col("event_id") % 4).cast("int")))
    calls = table(spark, sf_dir, "events").select(model.alias("model"), (F.col("event_id") % 50).cast("long").alias("n"))
    found = analytics.priced_by_prefix(calls, analytics.prices(spark, PRICES), "model")
    spent = analytics.cost(F.col("price_in"), F.col("price_out"), F.col("n"), F.col("n"))
    return found.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(100 * F.sum(spent) / F.count(F.lit(1)), 9).alias("per_hundred"), analytics.share(F.col("n") > 25).alias("long_share"))


@query("SELECT lang AS name FROM documents WHERE lang IS NOT NULL UNION SELECT event_type FROM events UNION SELECT role FROM conversations")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.known_names(*[table(spark, sf_dir, t).select(c) for t, c in (("documents", "lang"), ("events", "event_type"), ("conversations", "role"))])


@query("""
WITH r AS (SELECT o_custkey, list_distinct(list('s' || (o_orderkey % 7))) AS all_, coalesce(list_distinct(list('s' || (o_orderkey % 7)) FILTER (o_orderstatus = 'F')), []) AS cited FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_filter(all_, lambda x: NOT list_contains(cited, x))), ',') AS unused FROM r
""")
def unused_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.concat(F.lit("s"), F.col("o_orderkey") % 7)
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(site).alias("found"), F.collect_set(F.when(F.col("o_orderstatus") == "F", site)).alias("cited"))
    return o.select("o_custkey", F.array_join(answers.unused(F.col("found"), F.col("cited")), ",").alias("unused"))


@query("""
SELECT event_id, event_type AS event, '{"id":' || event_id || '}' || chr(10) || 'more' AS data FROM events
UNION ALL SELECT event_id, 'message', 'plain' FROM events
""")
def parsed_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames a text, read back; data over two lines, and a frame without an event."""
    text = F.concat(F.lit("event: "), "event_type", F.lit('\ndata: {"id":'), "event_id", F.lit("}\ndata:more\n\n: comment\n\ndata: plain\r\n\r\n"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(answers.parsed_frames(text)).alias("f")).select("event_id", "f.event", "f.data")


@query("""
WITH RECURSIVE i AS (SELECT o_custkey, 'order-' || o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
s AS (SELECT *, sum(length(x) + 2 + 1) OVER (PARTITION BY o_custkey ORDER BY i) + 1 AS used FROM i)
SELECT o_custkey, count(*) FILTER (used <= 100)::INT AS kept, count(*) FILTER (used > 100) > 0 AS truncated FROM s GROUP BY o_custkey
""")
def trimmed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as a JSON list of at most a hundred characters."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("order-"), k)).alias("items"))
    out = o.select("o_custkey", answers.trimmed(F.col("items"), 100).alias("t"))
    return out.select("o_custkey", F.size("t.items").alias("kept"), "t.truncated")


@query(f"""
WITH {_LINES}, e AS (SELECT doc_id, idx, 0 AS s FROM lines WHERE contains(lower(line), 'license')), m AS (SELECT doc_id, idx, 1 AS s FROM lines WHERE idx < 3),
f AS (SELECT doc_id, idx, min(s) AS s FROM (SELECT * FROM e UNION ALL SELECT * FROM m) GROUP BY ALL)
SELECT doc_id, string_agg(idx::VARCHAR, ',' ORDER BY s, idx) AS shown FROM f GROUP BY doc_id
""")
def focus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a word before the first lines of each document."""
    rows = corpus.lines(table(spark, sf_dir, "documents")).select("doc_id", "idx", "line").withColumn("at", F.col("idx"))
    out = answers.focused(rows.filter(corpus.contains(F.col("line"), "license")), rows.filter("idx < 3"), "doc_id", "idx", "at")
    return out.select("doc_id", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("shown"))


@query("""
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Ask user, assistant' WHEN conv_id % 3 = 1 THEN t || ' See also user, assistant' ELSE t END AS answer FROM (SELECT conv_id, min(text) AS t FROM conversations GROUP BY conv_id)
""")
def contact_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 3
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("text").alias("t"))
    status = F.when(k == 0, "not_found").when(k == 1, "partial").otherwise("answered")
    return c.select("conv_id", answers.with_contacts(F.col("t"), status, F.array(F.lit("user"), F.lit("assistant")), F.lit("Ask {names}"), F.lit("See also {names}")).alias("answer"))


@query("""
SELECT conv_id, asked, status, '["' || array_to_string(list_sort(list_distinct(roles)), '","') || '"]' AS sites FROM (SELECT conv_id, min(text) AS asked, CASE WHEN conv_id % 3 = 0 THEN 'not_found' WHEN conv_id % 3 = 1 THEN 'partial' ELSE 'answered' END AS status, list(role) AS roles FROM conversations GROUP BY conv_id) WHERE status <> 'answered'
""")
def gap_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 3
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("text").alias("asked"), F.collect_set("role").alias("roles"))
    rows = c.withColumn("s", F.when(k == 0, "not_found").when(k == 1, "partial").otherwise("answered"))
    return answers.gap_facts(rows, "conv_id", "asked", "s", "roles", "roles").select("conv_id", "asked", "status", "sites")


@query("""
WITH s AS (SELECT p.vec_id AS probe, e.vec_id AS card, round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings p WHERE p.vec_id % 20 = 0 AND e.vec_id % 20 <> 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, card) AS n FROM s) WHERE n <= 8),
g AS (SELECT probe, card, row_number() OVER (PARTITION BY probe ORDER BY score DESC, card)::INT AS place FROM t WHERE score >= 0.35)
SELECT probe, card, place FROM g WHERE place <= 2 UNION ALL SELECT probe, -1, 1 FROM (SELECT DISTINCT probe FROM t) WHERE probe NOT IN (SELECT probe FROM g)
""")
def picked_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest cards of each question above a threshold, else the general card."""
    from lectern.operators import ranking

    v = table(spark, sf_dir, "embeddings")
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding")
    near = ranking.batch_topk(probes, v.filter("vec_id % 20 <> 0"), 8).select("probe", F.col("vec_id").alias("card"), F.round("score", 9).alias("score"))
    return contacts.picked(near, spark.range(1).select(F.lit(-1).cast("long").alias("card")), "probe", "card", "score", 0.35)


@query("""
SELECT c_custkey, array_to_string(list_filter([trim(c_name), CASE WHEN c_nationkey % 2 = 0 THEN 'zona ' || c_nationkey ELSE '' END, c_mktsegment], lambda x: x <> ''), '. ') AS embed FROM customer
""")
def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cards made of customers are found by; the city's own name is cut out."""
    n = F.col("c_nationkey")
    area = F.when(n % 2 == 0, F.concat(F.lit("Primăria municipiului Chișinău | zona "), n)).otherwise("Primaria Chișinău")
    return table(spark, sf_dir, "customer").select("c_custkey", contacts.embed_text(F.col("c_name"), area, F.concat(F.lit(" - "), "c_mktsegment", F.lit(": "))).alias("embed"))


@query("""
WITH RECURSIVE r AS (SELECT l_suppkey, '| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_partkey || ' |' AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i FROM lineitem),
w AS (SELECT l_suppkey, sum(length(line) + 1) + 43 AS total, count(*) AS n FROM r GROUP BY 1),
g(l_suppkey, i, used, part) AS (
  SELECT l_suppkey, i, 43 + length(line) + 1, 0 FROM r WHERE i = 1
  UNION ALL SELECT r.l_suppkey, r.i, CASE WHEN g.used >= 1500 THEN 43 ELSE g.used END + length(r.line) + 1, g.part + CASE WHEN g.used >= 1500 THEN 1 ELSE 0 END FROM g JOIN r ON r.l_suppkey = g.l_suppkey AND r.i = g.i + 1
)
SELECT g.l_suppkey, CASE WHEN w.total <= 2500 THEN 0 ELSE part END::INT AS part, sha1('| order | line | part |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY g.i)) AS hash, count(*) AS n_rows
FROM g JOIN r ON r.l_suppkey = g.l_suppkey AND r.i = g.i JOIN w ON w.l_suppkey = g.l_suppkey GROUP BY 1, 2
""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the lines of each supplier, cut into groups of rows under their header."""
    cells = F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    cut = rows.select("l_suppkey", F.posexplode(documents.table_chunks(F.array(F.lit("order"), F.lit("line"), F.lit("part")), F.col("rows"))).alias("part", "t"))
    return cut.select("l_suppkey", "part", F.sha1("t").alias("hash"), (F.size(F.split("t", "\n")) - 2).cast("long").alias("n_rows"))


@query(f"""
WITH {_LINES}, b AS (SELECT doc_id, idx, line FROM lines WHERE idx % 3 <> 1)
SELECT l.doc_id, l.idx, min(b.idx)::INT AS block FROM lines l LEFT JOIN b ON b.doc_id = l.doc_id AND (contains(b.line, l.line) OR contains(l.line, b.line)) GROUP BY l.doc_id, l.idx
""")
def attributed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of each document, and the first block (two lines in three are one) that holds it or that it holds."""
    rows = corpus.lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("line").alias("text")))).alias("ls"))
    blocks = F.filter("ls", lambda b: b["idx"] % 3 != 1)
    return rows.select("doc_id", F.inline(F.transform("ls", lambda x: F.struct(x["idx"].alias("idx"), documents.attributed(x["text"], blocks)["idx"].alias("block")))))


@query("""
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber % 3))), ',') AS pages, count(*)::INT AS boxes FROM lineitem GROUP BY 1
""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and boxes of chunks made of the lines of an order."""
    block = F.struct("l_linenumber", (F.col("l_linenumber") % 3).alias("page"), F.array(F.array(F.col("l_quantity"), F.col("l_discount"))).alias("boxes"))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(block)).alias("bs"))
    return o.select("l_orderkey", F.array_join(F.transform(documents.pages_of(F.col("bs")), lambda p: p.cast("string")), ",").alias("pages"), F.size(documents.boxes_of(F.col("bs"))).alias("boxes"))


@query("""
SELECT CASE WHEN o_custkey % 2 = 0 THEN 'page:' ELSE '' END || o_custkey AS doc_id, CASE WHEN o_custkey % 3 = 0 THEN 'act' WHEN o_custkey % 2 = 0 THEN 'page' ELSE 'file' END AS kind, min(o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey
""")
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    chunks = table(spark, sf_dir, "orders").select(F.concat(F.when(c % 2 == 0, "page:").otherwise(""), c).alias("doc_id"), F.when(c % 3 == 0, "act").alias("kind"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("first_order"), F.col("o_orderstatus").alias("status"))
    return documents.document_records(chunks, ["first_order", "status"])


@query("""
SELECT page_id, n, kind, level, text FROM (
  SELECT page_id, 0 AS n, 'heading' AS kind, 2 AS level, 'Serviciul ' || page_id AS text FROM pages
  UNION ALL SELECT page_id, 1, 'paragraph', NULL, 'Se dă la cerere' FROM pages UNION ALL SELECT page_id, 2, 'paragraph', NULL, 'a & b' FROM pages
  UNION ALL SELECT page_id, 3, 'paragraph', NULL, 'Tarif: ' || (page_id % 90) || ' lei' FROM pages UNION ALL SELECT page_id, 4, 'list_item', NULL, 'Anexă: ' || url FROM pages
) WHERE page_id % 3 <> 0
""")
def embedded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of records that pages carry in a hidden text area; every third page's record has no title."""
    k = F.col("page_id")
    record = F.struct(F.when(k % 3 != 0, F.concat(F.lit(" Serviciul  "), k)).alias("title"), F.lit("<p>Se dă <b>la cerere</b></p><ul><li>a &amp; b</li></ul>").alias("about_html"), F.concat(k % 90, F.lit(" lei")).alias("fee"), F.array(F.struct(F.col("url").alias("url"))).alias("appendix"))
    data = F.replace(F.replace(F.replace(F.to_json(F.array(record)), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(F.lit("<body><textarea id=x hidden>"), data, F.lit("</textarea><p>text</p></body>"))
    records = table(spark, sf_dir, "pages").select("page_id", F.explode(web.embedded_records(html)).alias("r"))
    blocks = records.select("page_id", F.posexplode(web.record_blocks(F.col("r"))).alias("n", "b"))
    return blocks.select("page_id", "n", F.col("b.type").alias("kind"), "b.level", F.replace(F.col("b.text"), F.lit("&amp;"), F.lit("&")).alias("text"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '<h3>' || p_name || '</h3><p>Bilet: ' || p_size || ' lei</p><p>rest</p>' ELSE '<h3>' || p_name || '</h3><ul><li>Bilet</li><li>gratuit</li></ul><p>rest</p>' END AS html FROM part
""")
def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of toggles with lists of prices, rewritten; a list without a price stays."""
    price = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_size", F.lit("LEI."))).otherwise("gratuit")
    html = F.concat(F.lit("<summary class=a>"), "p_name", F.lit("</summary><ul><li>Bilet</li><li>"), price, F.lit("</li></ul><p>rest</p>"))
    out = F.replace(web.with_toggle_headings(web.with_price_lines(html)), F.lit(" LEI"), F.lit(" lei"))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("html"))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS k, o_orderkey, o_orderdate FROM orders)
SELECT doc_id, CASE k WHEN 0 THEN 'Cu privire la comanda ' || doc_id WHEN 1 THEN 'REGULAMENT despre lucru ' || doc_id WHEN 2 THEN 'Decizia nr. ' || doc_id || '/3' WHEN 3 THEN 'Un link lung ' || doc_id ELSE 'Primăria' END AS title,
  CASE k WHEN 0 THEN 'dispozitie' WHEN 1 THEN 'regulament' WHEN 2 THEN 'decizie' WHEN 3 THEN 'ordin' END AS doc_type,
  CASE k WHEN 0 THEN doc_id || '-d' WHEN 2 THEN doc_id || '/3' WHEN 3 THEN doc_id || '' END AS number,
  CASE WHEN k IN (0, 2) THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM o
""")
def described_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, type, number and date of documents with blocks and links written from orders in five forms."""
    k, form, day = F.col("o_orderkey"), F.col("o_orderkey") % 5, F.date_format("o_orderdate", "dd.MM.yyyy")
    block = lambda kind, *parts: F.struct(F.lit(kind).alias("type"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))
    forms = [
        F.array(block("heading", "Primăria"), block("paragraph", "DISPOZIȚIE nr. ", k, "-d"), block("paragraph", "din ", day), block("paragraph", "Cu privire la comanda ", k), block("paragraph", "1. Legea nr. 436/2006 din 01.02.2006")),
        F.array(block("heading", "Primăria municipiului"), block("heading", "REGULAMENT despre lucru ", k), block("paragraph", "text")),
        F.array(block("heading", "Decizia nr. ", k, "/3"), block("paragraph", "din ", day), block("paragraph", "Având în vedere nr. 9")),
        F.array(block("paragraph", "text simplu"), block("paragraph", "alt text")),
        F.array(block("paragraph", "nr. 7"), block("heading", "Primăria"), block("paragraph", "str. nr. 5")),
    ]
    blocks = forms[-1]
    for i, b in enumerate(forms[:-1]):
        blocks = F.when(form == i, b).otherwise(blocks)
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(k.alias("doc_id"), F.posexplode(blocks).alias("id", "b")).select("doc_id", "id", "b.*")
    link = lambda place, url, anchor: F.struct(F.lit(place).alias("place"), url.alias("url"), anchor.alias("anchor"))
    # the third form's file name writes the number without its mark
    file = F.when(form == 2, F.concat(F.lit("https://a.example/x/d-nr-"), k, F.lit("3.pdf"))).otherwise(F.lit("https://a.example/x/"))
    anchor = F.when(form == 3, F.concat(F.lit("Un link lung "), k)).when(form == 4, F.lit("")).otherwise(F.lit("scurt"))
    second = F.when(form == 3, F.concat(F.lit("Ordin nr. "), k)).otherwise(F.lit(""))
    links = orders.select(k.alias("doc_id"), F.explode(F.array(link(0, file, anchor), link(1, F.lit("https://a.example/"), second))).alias("s")).select("doc_id", "s.*")
    return titles.described(rows, links)
