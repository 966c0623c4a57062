"""More small functions over the given tables, each against its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import acts, questions, texts
from lectern.operators import analytics, answers, corpus, ranking, records, web
from lectern.queries.retrieval import _LINES
from lectern.registry import query
from lectern.session import checkpointed, table
from lectern.sources import readers

_LATIN, _CYRILLIC = "len(regexp_extract_all({0}, '\\p{{Latin}}'))", "len(regexp_extract_all({0}, '\\p{{Cyrillic}}'))"


@query("""
SELECT c_custkey, c_custkey % 4 < 2 AS valid FROM customer
""")
def valid_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written from customers: a local and an international one, one too short, one without a code."""
    k, digits = F.col("c_custkey") % 4, F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    phone = F.when(k == 0, F.concat(F.lit("(022) "), digits)).when(k == 1, F.concat(F.lit("+373 22-"), digits)).when(k == 2, F.concat(F.lit("022 "), F.substring(digits, 1, 5))).otherwise(F.concat(F.lit("00-1"), digits))
    return table(spark, sf_dir, "customer").select("c_custkey", texts.valid_phone(phone).alias("valid"))


@query("""
SELECT conv_id, turn, regexp_matches(text, '(?i)^[^\\p{L}\\p{N}_]*(who|which|when)($|[^\\p{L}\\p{N}_])') AS now, false AS talk FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, -1, conv_id % 2 = 0, conv_id % 2 = 1 FROM conversations GROUP BY conv_id
""".replace("\\\\", "\\"))
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about the current state, and small talk: those asked, and one written for each conversation."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", "text")
    written = c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.when(F.col("conv_id") % 2 == 0, "Кто сейчас примар города?").otherwise("Bună ziua!").alias("text"))
    both = asked.unionByName(written)
    return both.select("conv_id", "turn", questions.asks_for_now(F.col("text")).alias("now"), questions.small_talk(F.col("text")).alias("talk"))


@query("""
SELECT o_custkey, count(*) >= 3 AS roster, count(*) FILTER (o_orderstatus = 'F') > 0 AND max(o_orderkey) % 2 = 0 AS act FROM orders GROUP BY o_custkey
""")
def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of members written from a customer's orders, and which of them are acts."""
    line = F.concat(F.lit("| "), "o_orderkey", F.lit(" | președinte | Ion Rusu |"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "\n").alias("t"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.max("o_orderkey").alias("m"))
    act = questions.is_act(F.when(F.col("f") > 0, "decizie").otherwise("page"), F.when(F.col("m") % 2 == 0, "4/1").otherwise(""))
    return o.select("o_custkey", questions.is_roster(F.col("t")).alias("roster"), act.alias("act"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text || ' ş ţ Ş Ţ'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), 'ş', 'ș', 'g').replace('ţ', 'ț').replace('Ş', 'Ș').replace('Ţ', 'Ț'), chr(10) || ' ') AS text FROM documents
""")
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with letters to repair at their end."""
    t = F.concat("text", F.lit(" ş ţ Ş Ţ"))
    return table(spark, sf_dir, "documents").select("doc_id", texts.normalised(t).alias("text"))


@query("""
SELECT c_custkey, ['ro', 'ru', 'en', 'uk', 'ro', 'en'][(c_custkey % 6 + 1)::INT] AS code FROM customer
""")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, ["ro-MD", "RUS", " en_US", "ukr", "xx", "??"]))
    fallback = F.when(F.col("c_custkey") % 6 == 5, "the house of your friend is on this hill").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", texts.language_code(F.get(codes, (F.col("c_custkey") % 6).cast("int")), fallback).alias("code"))


@query(f"""
WITH q AS (SELECT conv_id, turn, text, {_CYRILLIC.format("text")} AS cyr, {_LATIN.format("text")} AS lat, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+'), lambda w: w IN ({", ".join(f"'{w}'" for w in texts.EN_WORDS)}))) AS en, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+'), lambda w: w IN ({", ".join(f"'{w}'" for w in texts.RO_WORDS)}))) AS ro FROM conversations)
SELECT conv_id, turn, CASE WHEN cyr + lat < 5 THEN 'xx' WHEN cyr > lat THEN 'ru' WHEN en > ro THEN 'en' ELSE 'ro' END AS lang FROM q
""".replace("\\\\", "\\"))
def question_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.question_language(F.col("text"), F.lit("xx")).alias("lang"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey || '/4' WHEN 1 THEN o_orderkey || '9' ELSE '12/' || o_custkey END AS number FROM orders
""")
def reconciled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of links against those of heads: written as in the head where the digits agree, the link's own else, the head's without a link's."""
    k = F.col("o_orderkey")
    link = F.when(k % 3 == 0, F.concat(F.lit("Decizie nr. "), k, F.lit("4"))).when(k % 3 == 1, F.concat(F.lit("nr "), k, F.lit("9"))).otherwise("fișier")
    head = F.when(k % 3 == 0, F.concat(F.lit("DECIZIE nr. 7/7 și nr. "), k, F.lit("/4"))).when(k % 3 == 1, F.lit("Ordin nr. 1")).otherwise(F.concat(F.lit("Hotărâre nr. 12/"), "o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", acts.reconciled_number(link, head).alias("number"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS published FROM orders
""")
def publication_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of pages written in four forms, and a page without one."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = [('<meta property="article:published_time" content="', 'T10:00:00Z">'), ("<META content='", "' name='date'>"), ('<time class=x datetime="', '">'), ('<meta itemprop="datePublished" content="', '"/>')]
    html = F.lit("<p>no date</p>")
    for i, (a, b) in enumerate(forms):
        html = F.when(F.col("o_orderkey") % 5 == i, F.concat(F.lit("<head><meta name=x content=1>" + a), day, F.lit(b))).otherwise(html)
    return table(spark, sf_dir, "orders").select("o_orderkey", web.publication_date(html).alias("published"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Decizie nr. ' || o_orderkey || ' din ' || strftime(o_orderdate, '%d.%m.%Y') || ' › Art. 3' WHEN 1 THEN 'Un titlu › Capitolul I' WHEN 2 THEN 'Un titlu › Capitolul I' ELSE 'Document › Art. 3' END AS label FROM orders
""")
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    path = F.when(k.isin(0, 3), F.array(F.lit("Art. 3"))).otherwise(F.array().cast("array<string>"))
    label = acts.citation_label(F.when(k == 1, "page").otherwise("file"), F.when(k != 3, "Un titlu"), F.when(k == 0, "DECIZIE"), F.when(k == 0, F.col("o_orderkey").cast("string")), F.when(k == 0, F.date_format("o_orderdate", "dd.MM.yyyy")), path, F.array(F.lit("Capitolul I")))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))


@query(r"""
WITH t AS (SELECT page_id, sha1(lower(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))) AS print FROM pages) SELECT page_id, print, count(*) OVER (PARTITION BY print) AS copies FROM t
""")
def page_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the texts of pages, and on how many pages each stands."""
    p = table(spark, sf_dir, "pages").select("page_id", web.fingerprint(F.regexp_replace("html", "<[^>]*>", " ")).alias("print"))
    return p.join(p.groupBy("print").agg(F.count(F.lit(1)).alias("copies")), "print")


@query("""
SELECT s_suppkey, CASE WHEN site = 'a' AND seen < 50 AND (status IS NULL OR status < 400) THEN 410 ELSE status END AS status, site = 'a' AND seen < 50 AND (status IS NULL OR status < 400) AS gone
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS site, s_suppkey % 100 AS seen, CASE s_suppkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS status FROM supplier)
""")
def dropped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a site that a complete crawl did not reach."""
    k = F.col("s_suppkey")
    pages = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 2 == 0, "a").otherwise("b").alias("site"), (k % 100).alias("fetched_at"), F.when(k % 3 == 0, 200).when(k % 3 == 1, 404).alias("status"), F.lit(None).cast("string").alias("error"))
    return records.unseen_dropped(pages, "a", F.lit(50)).select("s_suppkey", "status", F.col("error").isNotNull().alias("gone"))


@query("""
SELECT c_custkey AS id, 'stored' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT DISTINCT o_custkey, 'seen' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
""")
def seeded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are known, and those that are only seen, put in once."""
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.lit("stored").alias("origin"))
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("origin", F.lit("seen"))
    return records.inserted(stored, seen, "id")


@query("""
WITH s AS (SELECT c_custkey, TIMESTAMP '2024-03-10 12:00:00' AS now, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-03-10 12:00:00' - to_hours(CAST(c_custkey % 11 AS BIGINT)) END AS last, CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2024-03-10 12:00:00' + to_hours(CAST(c_custkey % 7 AS BIGINT)) END AS next FROM customer),
e AS (SELECT *, greatest(now, coalesce(last + INTERVAL 6 HOUR, now)) AS earliest FROM s)
SELECT c_custkey, strftime(coalesce(least(next, earliest), earliest), '%Y-%m-%d %H:%M') AS next_check FROM e
""")
def next_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When sources with a stale signal are looked at again."""
    now, k = F.lit("2024-03-10 12:00:00").cast("timestamp"), F.col("c_custkey")
    at = records.next_check(F.when(k % 3 > 0, F.timestamp_add("HOUR", k % 7, now)), F.when(k % 4 > 0, F.timestamp_add("HOUR", -(k % 11), now)), now)
    return table(spark, sf_dir, "customer").select("c_custkey", F.date_format(at, "yyyy-MM-dd HH:mm").alias("next_check"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 100 + c_nationkey ELSE c_nationkey END AS grp FROM customer
""")
def decided_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of rows after stored decisions about some of them."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("grp"))
    decisions = table(spark, sf_dir, "nation").filter("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") + 100).alias("decided"))
    return records.grouped_decisions(rows, decisions, "key", "grp").select("c_custkey", "grp")


@query("""
WITH r AS (SELECT event_id AS answer_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS head, ts, ['partial', 'not_found', 'refused'][(event_id % 3 + 1)::INT] AS status, event_id % 97 = 0 AS hidden, CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'answered' ELSE 'partial' END END AS rechecked FROM events),
d AS (SELECT DISTINCT head, head % 50 AS batch, head % 7 AS label FROM r WHERE head % 4 > 0),
f AS (SELECT batch, label, CASE WHEN label = 0 THEN batch ELSE min(head) END AS grp FROM d GROUP BY batch, label),
g AS (SELECT r.*, coalesce(f.grp, r.head) AS grp FROM r LEFT JOIN d ON d.head = r.head LEFT JOIN f ON f.batch = d.batch AND f.label = d.label),
i AS (SELECT grp, count(*) AS n, max(ts) AS last_asked, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'not_found') AS not_found, bool_or(hidden) AS hid, arg_max(rechecked, (ts, answer_id)) FILTER (rechecked IS NOT NULL) AS re FROM g GROUP BY grp),
s AS (SELECT * FROM i WHERE NOT hid AND re IS DISTINCT FROM 'answered')
SELECT o AS ordered, grp, n, partial, not_found FROM (
  SELECT 'count' AS o, *, row_number() OVER (ORDER BY n DESC, last_asked DESC, grp) AS k FROM s UNION ALL SELECT 'recent', *, row_number() OVER (ORDER BY last_asked DESC, grp) FROM s
  UNION ALL SELECT 'partial', *, row_number() OVER (ORDER BY partial DESC, n DESC, last_asked DESC, grp) FROM s UNION ALL SELECT 'not_found', *, row_number() OVER (ORDER BY not_found DESC, n DESC, last_asked DESC, grp) FROM s) WHERE k <= 50
""")
def gap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as questions, their wording groups sorted into groups by decisions in batches, and the list of groups in its four orders."""
    k = F.col("event_id")
    head = F.min("event_id").over(Window.partitionBy("user_id", "event_type"))
    status = F.get(F.array(*map(F.lit, ["partial", "not_found", "refused"])), (k % 3).cast("int"))
    rechecked = F.when(k % 11 == 0, F.when(k % 2 == 0, "answered").otherwise("partial"))
    rows = checkpointed(table(spark, sf_dir, "events").select(k.alias("answer_id"), head.alias("head"), F.col("ts").alias("created_at"), status.alias("status"), (k % 97 == 0).alias("hidden"), rechecked.alias("rechecked")))
    batch, label = F.col("head") % 50, F.col("head") % 7
    decisions = rows.select("head").distinct().filter("head % 4 > 0").select(batch.alias("batch"), F.col("head").alias("n"), "head", label.alias("label"), F.when(label == 0, batch).alias("known"))
    groups = checkpointed(analytics.sorted_heads(decisions))
    out = None
    for order in analytics.GAP_ORDERS:
        part = analytics.gap_list(rows, groups, order).select(F.lit(order).alias("ordered"), F.col("group").alias("grp"), F.col("count").alias("n"), "partial", "not_found")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS d FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS LAST, o_orderkey)::INT AS place FROM r
""")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by date, undated ones after them in their order."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("d"))
    return ranking.ranked(o, ["o_custkey"], *ranking.newest_first(o, "d", "o_orderkey")).select("o_custkey", "o_orderkey", F.col("rank").alias("place"))


@query("""
WITH b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 4 <> 0), f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 4 = 0),
u AS (SELECT *, CASE WHEN n <= 6 THEN 0 ELSE 2 END AS s FROM b UNION ALL SELECT *, 1 FROM f)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY s, n)::INT AS place FROM u
""")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six of a list, then fresh ones, then the rest."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    part = lambda cond: ranking.ranked(o.filter(cond), ["o_custkey"], "o_orderkey").withColumnRenamed("rank", "n")
    return ranking.interleaved(part("o_orderkey % 4 <> 0"), part("o_orderkey % 4 = 0"), "o_custkey", "n").select("o_custkey", "o_orderkey", "place")


@query(f"""
WITH {_LINES}, k AS (SELECT *, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS k FROM lines),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY idx) AS n FROM k WHERE regexp_matches(k, '\\p{{L}}')),
g AS (SELECT *, lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM o WHERE n = 1)
SELECT doc_id, sha1(string_agg(CASE WHEN before <> idx - 1 THEN '…' || chr(10) ELSE '' END || 'S' || doc_id || '.L' || idx || ': ' || line, chr(10) ORDER BY idx)) AS prompt FROM g GROUP BY doc_id
""".replace("\\\\", "\\"))
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt text of every document: each of its lines once, marks where some are left out."""
    rows = corpus.lines(table(spark, sf_dir, "documents")).select("doc_id", "idx", "line").withColumn("q", F.col("doc_id"))
    shown = answers.shown_lines(rows, "q", "doc_id", "idx", "line")
    return answers.rendered(shown, "q", "doc_id", "idx", "line").select("doc_id", F.sha1("prompt").alias("prompt"))


@query("""
WITH h AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx DESC) AS p FROM (SELECT doc_id, (i + 1)::INT AS idx FROM (SELECT doc_id, unnest(range(0, 12)) AS i FROM documents) WHERE (doc_id + i) % 7 = 0 AND doc_id % 3 <> 0)),
l AS (SELECT doc_id, (i + 1)::INT AS n, (doc_id % 6 + 1) AS place FROM (SELECT doc_id, unnest(range(0, 12)) AS i FROM documents))
SELECT l.doc_id, l.n FROM l WHERE EXISTS (SELECT 1 FROM (SELECT doc_id, idx FROM h WHERE p <= 2 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)) x WHERE x.doc_id = l.doc_id AND abs(l.n - x.idx) <= CASE WHEN l.place <= 4 THEN 5 ELSE 2 END)
""")
def source_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve lines a document, those around its best two hits, more widely in the first sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    lines = docs.select("doc_id", (F.col("doc_id") % 6 + 1).alias("place"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n"))
    hits = lines.filter("(doc_id + n - 1) % 7 = 0 and doc_id % 3 <> 0").select("doc_id", "n", (-F.col("n")).alias("rank"))
    return answers.windows(lines, hits, "doc_id", "n", "place").select("doc_id", "n")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN '022 ' || c_custkey || '-77' END AS phone, CASE WHEN c_custkey % 2 = 0 THEN 'Info' || c_custkey || '@a.md' END AS email FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 2 = 0
""")
def backed_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of answers that the cited lines bear out."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    found = c.select("c_custkey", F.concat(F.lit("022 "), k, F.lit("-77")).alias("phone"), F.concat(F.lit("Info"), k, F.lit("@a.md")).alias("email"))
    lines = c.select("c_custkey", F.array(F.when(k % 3 != 1, F.concat(F.lit("tel. (022) "), k, F.lit(" 77"))).otherwise("fără telefon"), F.when(k % 2 == 0, F.concat(F.lit("e-mail: INFO"), k, F.lit("@A.MD"))).otherwise("-")).alias("texts"))
    return answers.verified_contacts(found, lines, "c_custkey")


@query("""
SELECT DISTINCT text AS quote, CASE conv_id % 3 WHEN 0 THEN 'ro' WHEN 1 THEN 'ru' ELSE 'en' END AS quote_lang FROM conversations WHERE conv_id % 3 <> 0 AND turn % 2 = 0
""")
def untranslated_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 3
    quotes = table(spark, sf_dir, "conversations").select(F.col("text").alias("quote"), F.when(k == 0, "ro").when(k == 1, "ru").otherwise("en").alias("quote_lang"), F.when(F.col("turn") % 2 == 1, "done").alias("translation"))
    return answers.untranslated(quotes, F.lit("ro"))


@query("""
SELECT doc_id % 4 AS pair, count(*) AS measured FROM (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE quality IS DISTINCT FROM 0 AND toxic IS DISTINCT FROM 1 GROUP BY 1
""")
def measured_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases made of documents, without negative ones (of low quality) and those taken out (toxic)."""
    cases = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", (F.col("quality") == 0).alias("is_negative"), (F.col("toxic") == 1).alias("exclude_from_metric"))
    return readers.measured(cases).groupBy((F.col("doc_id") % 4).alias("pair")).agg(F.count(F.lit(1)).alias("measured"))
