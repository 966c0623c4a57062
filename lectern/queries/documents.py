"""Texts of documents: language, contacts, masking, acts, chunks, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import acts, texts
from lectern.operators import corpus, documents
from lectern.queries.retrieval import _LINES
from lectern.registry import query
from lectern.session import table

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_PHONE = r"(?:(?:\+373|0)\s*\(?\d{2,3}\)?[\s.-]*\d{2,3}[\s.-]*\d{2,4})"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')"
_IN = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"


@query(f"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{{Cyrillic}}')) AS cyr, len(regexp_extract_all(text, '\\p{{Latin}}')) AS lat,
  len(list_filter({_WORDS}, lambda w: w IN {_IN(texts.EN_WORDS)})) AS en, len(list_filter({_WORDS}, lambda w: w IN {_IN(texts.RO_WORDS)})) AS ro FROM documents)
SELECT doc_id, CASE WHEN cyr = 0 AND lat = 0 THEN NULL WHEN cyr > lat THEN 'ru' WHEN en > ro THEN 'en' ELSE 'ro' END AS detected FROM n
""")
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.detected_language(F.col("text")).alias("detected"))


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def lang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"SELECT doc_id, regexp_matches(text, '{_PHONE}') OR regexp_matches(text, '\\b{_EMAIL}') AS has_contacts, list_distinct(regexp_extract_all(text, '\\b{_EMAIL}')).len()::INT AS n_emails FROM documents")
def contact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", texts.has_contacts(text).alias("has_contacts"), F.size(texts.emails(text)).alias("n_emails"))


@query(r"""
WITH m AS (SELECT doc_id, regexp_replace(text, '[\p{L}\p{N}\p{M}\p{Pc}.+-]+@[\p{L}\p{N}\p{M}\p{Pc}-]+(?:\.[\p{L}\p{N}\p{M}\p{Pc}-]+)+|\+?\d[\d\s().-]{5,}\d', '•••', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 199) || '…' ELSE t END AS masked FROM m
""")
def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.masked(F.col("text")).alias("masked"))


_NUM = r"list_transform(regexp_extract_all(regexp_replace({0}, '(\d)[\s .](\d{{3}}\b)', '\1\2', 'g'), '\d+(?:[.,]\d+)?'), lambda n: replace(n, ',', '.'))"
_BARE = "CASE WHEN ltrim({0}, '0') = '' THEN '0' ELSE ltrim({0}, '0') END"


@query(f"""
WITH c AS (SELECT conv_id, turn, list_distinct(list_transform({_NUM.format("'case ' || turn || ' of ' || conv_id || ', 0' || length(text) || ',50'")}, lambda n: {_BARE.format("n")})) AS wanted, {_NUM.format("text || ' ' || conv_id || ' ' || turn || ' ' || (length(text) - length(text) % 2) || '.50'")} AS e FROM conversations),
h AS (SELECT conv_id, turn, wanted, list_concat(list_transform(e, lambda n: {_BARE.format("n")}), flatten(list_transform(e, lambda n: list_transform(string_split(n, '.'), lambda p: {_BARE.format("p")})))) AS have FROM c)
SELECT conv_id, turn, len(wanted)::INT AS n_numbers, len(list_filter(wanted, lambda x: NOT list_contains(have, x))) = 0 AS backed FROM h
""")
def numbers_backed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with numbers derived from each turn, half of them backed by the evidence made of the turn."""
    n = F.length("text")
    claim = F.concat(F.lit("case "), "turn", F.lit(" of "), "conv_id", F.lit(", 0"), n, F.lit(",50"))
    evidence = F.array(F.concat_ws(" ", "text", "conv_id", "turn", F.concat(n - n % 2, F.lit(".50"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(acts.claim_numbers(claim)).alias("n_numbers"), acts.numbers_backed(claim, evidence).alias("backed"))


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate, o_orderkey % 4 AS k, ['Decizie', 'Hotărâre', 'Ordin', 'Legea'][(o_orderkey % 4 + 1)::INT] AS word FROM orders)
SELECT o_orderkey, ['decizie', 'hotarare', 'ordin', 'lege'][(k + 1)::INT] AS act_type, o_orderkey || '/' || (o_orderkey % 7 + 1) AS number, strftime(o_orderdate, '%Y-%m-%d') AS date FROM t
""")
def act_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of acts written from orders, read back: type, number and date."""
    k = F.col("o_orderkey")
    word = F.get(F.array(*map(F.lit, ["Decizie", "Hotărâre", "Ordin", "Legea"])), (k % 4).cast("int"))
    month = F.get(F.array(*map(F.lit, acts.MONTHS_RO)), F.month("o_orderdate") - 1)
    by_word = F.concat(F.dayofmonth("o_orderdate"), F.lit(" "), month, F.lit(" "), F.year("o_orderdate"))
    date = F.when(k % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(by_word)
    title = F.concat(word, F.lit(" nr. "), k, F.lit("/"), k % 7 + 1, F.lit(" din "), date)
    titled = table(spark, sf_dir, "orders").select("o_orderkey", title.alias("t"))
    return titled.select("o_orderkey", acts.act_type(F.col("t")).alias("act_type"), F.get(acts.act_numbers(F.col("t")), 0).alias("number"), acts.act_date(F.col("t")).alias("date"))


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_linenumber % 7 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, k::INT AS level, CASE k WHEN 0 THEN 'Anexa nr. ' || l_orderkey WHEN 1 THEN 'Capitolul ' || l_orderkey WHEN 2 THEN 'Secțiunea ' || l_orderkey WHEN 3 THEN 'Art. ' || l_orderkey
  WHEN 4 THEN 'pct. ' || l_orderkey WHEN 5 THEN 'alin. (' || l_orderkey || ')' ELSE 'lit. b)' END AS label FROM i
""")
def legal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of acts written from line items, recognised."""
    k, n = F.col("l_linenumber") % 7, F.col("l_orderkey").cast("string")
    forms = ["ANEXA nr. {}", "Capitolul {}", "Sectiunea {} Dispoziții", "art. {} Obiectul", "{}. Se aprobă", "({}) Prezenta", "b) punctul"]
    text = F.lit("")
    for i, form in enumerate(forms):
        text = F.when(k == i, F.concat(F.lit(form.split("{}")[0]), n if "{}" in form else F.lit(""), F.lit(form.split("{}")[1] if "{}" in form else ""))).otherwise(text)
    item = acts.legal_item(text)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", item["level"].alias("level"), item["label"].alias("label"))


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, (l_partkey % 4)::INT AS level, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1),
s AS (SELECT l_orderkey, l_linenumber, level, l_partkey, list((level, l_linenumber, l_partkey)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS seen FROM i)
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_filter(range(0, 4), lambda v: len(list_filter(seen, lambda x: x[1] = v)) > 0
   AND list_max(list_transform(list_filter(seen, lambda x: x[1] = v), lambda x: x[2])) > coalesce(list_max(list_transform(list_filter(seen, lambda x: x[1] < v), lambda x: x[2])), -1)),
   lambda v: v || ':' || list_filter(seen, lambda x: x[1] = v)[len(list_filter(seen, lambda x: x[1] = v))][3]), '>') AS path FROM s
""")
def legal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack paths over line items, with levels from part numbers."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey"))["l_partkey"].alias("l_partkey"))
    level = (F.col("l_partkey") % 4).cast("int")
    label = F.concat(level, F.lit(":"), F.col("l_partkey"))
    path = documents.stacked(items, "l_orderkey", "l_linenumber", level, label, 4, F.lit(None).cast("int"))
    return items.select("l_orderkey", "l_linenumber", F.array_join(path, ">").alias("path"))


@query(f"""
WITH {_LINES}, b AS (SELECT doc_id, idx, line, idx // 3 AS c FROM lines WHERE idx % 12 < 9), d AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'page' ELSE 'file' END AS kind FROM documents)
SELECT doc_id, c * 3 AS first_block, string_agg(idx, ',' ORDER BY idx) AS blocks, array_to_string(list_sort(list_distinct(list(idx // 2))), ',') AS pages, count(*)::INT * 2 AS n_boxes, bool_or(idx % 5 = 4) AS has_contacts,
  CASE WHEN any_value(kind) = 'page' THEN any_value(source) WHEN doc_id % 3 = 1 THEN 'Decizie nr. ' || doc_id ELSE any_value(source) END || ' › ' || any_value(lang) AS label,
  sha1(any_value(source) || chr(10) || label || chr(10) || 'text') AS hash
FROM b JOIN d USING (doc_id) GROUP BY doc_id, c
""")
def chunk_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, nine in twelve of them in chunks of three: the chunks' blocks, pages, boxes, contacts and labels."""
    docs = table(spark, sf_dir, "documents")
    lines = corpus.lines(docs, keep=("lang",)).select("doc_id", F.col("idx").alias("id"), "lang")
    blocks = lines.select("doc_id", "id", F.expr("id div 2").alias("page"), F.array(F.array(F.col("id").cast("double")), F.array(F.lit(0.5))).alias("boxes"), (F.col("id") % 5 == 4).alias("has_contacts"))
    spans = lines.filter("id % 12 < 9").groupBy("doc_id", "lang", F.expr("id div 3").alias("c")).agg(F.max("id").cast("long").alias("last_block"))
    none = F.array().cast("array<string>")
    chunks = spans.select("doc_id", (F.col("c") * 3).alias("first_block"), "last_block", F.lit("text").alias("text"), F.array("lang").alias("section"), none.alias("legal_path"), F.lit(False).alias("has_contacts"))
    act = F.col("doc_id") % 3 == 1
    about = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "page").otherwise("file").alias("kind"), F.col("source").alias("title"), F.when(act, "decizie").alias("doc_type"), F.when(act, F.col("doc_id").cast("string")).alias("number"), F.lit(None).cast("string").alias("date"))
    out = documents.described_chunks(chunks, blocks, about)
    said = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("doc_id", "first_block", said("block_ids").alias("blocks"), said("pages").alias("pages"), F.size("boxes").alias("n_boxes"), "has_contacts", F.col("citation_label").alias("label"), F.sha1("embed_text").alias("hash"))


@query()
def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.chunked(documents.text_blocks(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "ord", "chunk_id", "content_hash", F.length("text").alias("n_chars"), "lang", "has_contacts")


@query(rf"""
WITH RECURSIVE {_LINES},
s AS (SELECT doc_id, idx, j, trim(parts[j]) AS t FROM (SELECT doc_id, idx, CASE WHEN length(line) > 400 THEN string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [line] END AS parts FROM lines), LATERAL unnest(range(1, len(parts) + 1)) AS u(j) WHERE trim(parts[j]) <> ''),
w AS (SELECT doc_id, idx, j, string_split_regex(t, '\s+') AS ws FROM s WHERE length(t) > 400),
k(doc_id, idx, j, m, now, size, line) AS (
  SELECT doc_id, idx, j, 1, ws[1], length(ws[1]) + 1, NULL::VARCHAR FROM w
  UNION ALL SELECT w.doc_id, w.idx, w.j, m + 1, CASE WHEN now <> '' AND size + length(ws[m + 1]) + 1 > 350 THEN ws[m + 1] WHEN now = '' THEN ws[m + 1] ELSE now || ' ' || ws[m + 1] END,
    CASE WHEN now <> '' AND size + length(ws[m + 1]) + 1 > 350 THEN length(ws[m + 1]) ELSE size + length(ws[m + 1]) + 1 END, CASE WHEN now <> '' AND size + length(ws[m + 1]) + 1 > 350 THEN now END
  FROM k JOIN w ON w.doc_id = k.doc_id AND w.idx = k.idx AND w.j = k.j WHERE m < len(ws)
),
x AS (SELECT doc_id, idx, j, 0 AS m, t FROM s WHERE length(t) <= 400 UNION ALL SELECT doc_id, idx, j, m, line FROM k WHERE line IS NOT NULL
  UNION ALL SELECT k.doc_id, k.idx, k.j, m + 1, now FROM k JOIN w ON w.doc_id = k.doc_id AND w.idx = k.idx AND w.j = k.j WHERE m = len(ws) AND now <> ''),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, j, m) AS p, count(*) OVER (PARTITION BY doc_id) AS n, t FROM x),
r(doc_id, p, held, line) AS (
  SELECT doc_id, p, CASE WHEN length(t) < 25 THEN t ELSE '' END, CASE WHEN length(t) >= 25 THEN t END FROM p WHERE p = 1
  UNION ALL SELECT doc_id, p, CASE WHEN length(t) < 25 THEN t ELSE '' END, CASE WHEN length(t) >= 25 THEN t END FROM (SELECT p.doc_id, p.p, CASE WHEN r.held = '' THEN p.t ELSE r.held || ' ' || p.t END AS t FROM r JOIN p ON p.doc_id = r.doc_id AND p.p = r.p + 1)
),
o AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS n FROM r WHERE line IS NOT NULL),
h AS (SELECT r.doc_id, held FROM r JOIN p ON p.doc_id = r.doc_id AND p.p = r.p WHERE p.p = p.n AND held <> ''),
f AS (SELECT o.doc_id, o.idx, CASE WHEN o.idx = o.n - 1 AND held IS NOT NULL THEN line || ' ' || held ELSE line END AS line FROM o LEFT JOIN h ON h.doc_id = o.doc_id
  UNION ALL SELECT doc_id, 0, held FROM h WHERE doc_id NOT IN (SELECT doc_id FROM o))
SELECT doc_id, idx::INT AS idx, sha1(doc_id || ':' || idx) AS line_id, sha1(line) AS content_hash, length(line)::INT AS n_chars FROM f
""")
def fine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.fine_lines(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", "idx", "line_id", "content_hash", F.length("line").alias("n_chars"))


@query("""
WITH r AS (SELECT l_orderkey, list('' || l_linenumber ORDER BY l_linenumber) AS a, list(l_returnflag ORDER BY l_linenumber) AS b FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY l_orderkey)
SELECT l_orderkey, '| line | flag |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(range(1, len(a) + 1), lambda i: '| ' || a[i] || ' | ' || CASE WHEN a[i]::INT % 2 = 0 THEN b[i] ELSE '' END || ' |'), chr(10)) AS markdown FROM r
""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown table for each order; odd lines have one cell and are padded."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    n = F.col("l_linenumber").cast("string")
    cells = F.when(F.col("l_linenumber") % 2 == 0, F.array(n, "flag")).otherwise(F.array(n))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("c")))).alias("r"))
    return rows.select("l_orderkey", texts.markdown_table(F.array(F.lit("line"), F.lit("flag")), F.transform("r", lambda x: x["c"])).alias("markdown"))


@query(r"""
WITH t AS (SELECT conv_id, turn, string_split_regex(trim(text), '\s+') AS raw FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, list_transform(raw, lambda t: regexp_replace(regexp_replace(t, '[&|!()\\:*''"]', '', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS x FROM t)
SELECT conv_id, turn, array_to_string(CASE WHEN len(list_filter(x, lambda t: length(t) >= 3 AND lower(t) NOT IN ('cat','cât','cum','unde','care','pentru','este','sunt','cine','cand','când','daca','dacă'))) > 0
  THEN list_filter(x, lambda t: length(t) >= 3 AND lower(t) NOT IN ('cat','cât','cum','unde','care','pentru','este','sunt','cine','cand','când','daca','dacă')) ELSE list_filter(x, lambda t: length(t) >= 2) END, ' | ') AS terms FROM c
""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(texts.query_terms(F.col("text")), " | ").alias("terms"))
