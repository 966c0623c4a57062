"""Answer assembly and the whole of hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import questions, urls
from lectern.operators import answers, contacts, corpus, ranking
from lectern.operators.embedding import continued, embedded
from lectern.plans.retrieve import retrieve
from lectern.queries.retrieval import _ASKED, _LINES, _TERMS
from lectern.queries.stems_sql import WORDS, density, romanian
from lectern.registry import query
from lectern.session import table


@query("""
WITH RECURSIVE c AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, doc_id, n_chars::BIGINT AS size FROM documents),
r(source, i, used, taken, n) AS (
  SELECT source, i, size, true, 1 FROM c WHERE i = 1
  UNION ALL SELECT c.source, c.i, CASE WHEN r.used + c.size <= 6500 THEN r.used + c.size ELSE r.used END, r.used + c.size <= 6500, r.n + CASE WHEN r.used + c.size <= 6500 THEN 1 ELSE 0 END FROM r JOIN c ON c.source = r.source AND c.i = r.i + 1
)
SELECT r.source, n::INT AS source_no, doc_id, size FROM r JOIN c ON c.source = r.source AND c.i = r.i WHERE taken
""")
def source_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").cast("long").alias("size"))
    return answers.greedy_budget(docs, "source", "doc_id", "doc_id", "size", 6500)


@query(rf"""
WITH {_LINES}, k AS (SELECT *, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS k FROM lines),
o AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY doc_id, idx) AS n FROM k WHERE regexp_matches(k, '\p{{L}}'))
SELECT source, doc_id, idx, 'S' || doc_id || '.L' || idx AS ref FROM o WHERE n = 1
""")
def shown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.lines(table(spark, sf_dir, "documents"), keep=("source",))
    return answers.shown_lines(rows, "source", "doc_id", "idx", "line").select("source", "doc_id", "idx", "ref")


@query("""
WITH s AS (SELECT o_custkey AS answer_id, o_orderkey AS sentence, ['S' || (o_orderkey % 5), 'S' || (o_orderkey % 7), 'S' || (o_orderkey % 5)] AS refs FROM orders),
l AS (SELECT DISTINCT o_custkey AS answer_id, 'S' || (o_orderkey % 4) AS ref, 'quote ' || (o_orderkey % 4 % 2) AS quote, 'site' AS site FROM orders),
r AS (SELECT answer_id, sentence, ref, min(pos) AS pos FROM (SELECT answer_id, sentence, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM s) GROUP BY ALL),
k AS (SELECT r.*, quote, site FROM r JOIN l USING (answer_id, ref)),
f AS (SELECT answer_id, quote, site, row_number() OVER (PARTITION BY answer_id ORDER BY min((sentence, pos)), quote, site)::INT AS citation FROM k GROUP BY answer_id, quote, site)
SELECT answer_id, sentence, ref, citation FROM k JOIN f USING (answer_id, quote, site)
""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with refs made of orders; some name lines that were not shown."""
    o = table(spark, sf_dir, "orders")
    name = lambda n: F.concat(F.lit("S"), F.col("o_orderkey") % n)
    sentences = o.select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("sentence"), F.array(name(5), name(7), name(5)).alias("refs"))
    lines = o.select(F.col("o_custkey").alias("answer_id"), name(4).alias("ref"), F.concat(F.lit("quote "), F.col("o_orderkey") % 4 % 2).alias("quote"), F.lit("site").alias("site")).distinct()
    return answers.cited(sentences, lines)


@query("SELECT conv_id, turn, text, true AS done, len(string_split(text, ' '))::BIGINT AS deltas FROM conversations WHERE role = 'assistant'")
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut into events and put together again."""
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'").withColumn("answer_id", F.struct("conv_id", "turn"))
    stream = answers.events(said, "answer_id", "text")
    counts = stream.filter("event = 'delta'").groupBy("answer_id").agg(F.count(F.lit(1)).alias("deltas"))
    return answers.reduced(stream, "answer_id").join(counts, "answer_id").select("answer_id.conv_id", "answer_id.turn", "text", "done", "deltas")


@query("""SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"id":' || event_id || ',"user":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")))
    return table(spark, sf_dir, "events").select("event_id", answers.frame(F.col("event_type"), data).alias("frame"))


@query("""
SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') >= 2 THEN 'conflict' WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'not_found' WHEN count(*) FILTER (role = 'user') > count(*) FILTER (role = 'assistant') THEN 'partial' ELSE 'answered' END AS status FROM conversations GROUP BY conv_id
""")
def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda role: F.count_if(F.col("role") == role)
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n("system").alias("s"), n("assistant").alias("a"), n("user").alias("u"))
    return c.select("conv_id", answers.status(F.col("s"), F.greatest(F.col("u") - F.col("a"), F.lit(0)), F.col("a")).alias("status"))


_PROBED = "SELECT p.vec_id AS query_id, e.vec_id, list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank FROM embeddings e, embeddings p WHERE p.vec_id % 20 = 0 AND e.vec_id % 2 = {}"
_HYBRID = rf"""
WITH {_LINES}, {_ASKED},
toks AS (SELECT doc_id, idx, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, idx, {WORDS.format("line")} AS w FROM lines)),
vocabulary AS (SELECT w FROM toks UNION SELECT w FROM qw), {romanian("vocabulary", "stems")}, {_TERMS},
t AS (SELECT doc_id, idx, pos, s FROM toks JOIN stems USING (w)), {density("t", "alts", "doc_id, idx")},
ls AS (SELECT item_id * 20 AS query_id, doc_id, idx, 0.1::DOUBLE * covers AS score FROM found),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, idx) AS rank FROM ls) WHERE rank <= 60),
ts AS (SELECT query_id, doc_id, round(sum(score), 9) AS score FROM ls GROUP BY ALL),
ct AS (SELECT * FROM (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ts) WHERE rank <= 30),
cv AS (SELECT query_id, vec_id AS chunk_id, rank FROM ({_PROBED.format(0)}) WHERE rank <= 30),
lv AS (SELECT query_id, vec_id::VARCHAR AS line_id, vec_id - 1 AS chunk_id, score, rank FROM ({_PROBED.format(1)}) WHERE rank <= 60),
cr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), chunk_id) AS rank FROM lv GROUP BY query_id, chunk_id),
u AS (SELECT *, 1.0::DOUBLE AS w, 0 AS place FROM cv UNION ALL SELECT *, 1.0, 1 FROM cr UNION ALL SELECT *, 0.1, 2 FROM ct),
f AS (SELECT query_id, chunk_id, list_sum(list(w / (60 + rank) ORDER BY place)) AS score, min(place * 1000000 + rank) AS o FROM u GROUP BY ALL),
r AS (SELECT f.*, text, source, sha1(text) AS hash, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS priority FROM f JOIN documents ON doc_id = chunk_id),
b AS (SELECT *, max(score) OVER (PARTITION BY query_id, hash) AS best, row_number() OVER (PARTITION BY query_id, hash ORDER BY priority DESC, score DESC, o) AS copy FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, o)::INT AS position FROM b WHERE copy = 1),
ml AS (SELECT query_id, line_id, chunk_id, score, rank, 0 AS list FROM lv UNION ALL SELECT query_id, doc_id || ':' || idx, doc_id, score, rank, 1 FROM lt),
mo AS (SELECT query_id, chunk_id, line_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, line_id ORDER BY list, rank) AS n FROM ml) WHERE n = 1),
m AS (SELECT query_id, chunk_id, least(count(*), 3)::INT AS n FROM mo GROUP BY ALL),
op AS (SELECT doc_id AS chunk_id, count(*)::INT AS n FROM lines WHERE idx < 3 GROUP BY doc_id)
SELECT p.query_id, position, p.chunk_id, round(best, 12) AS score, coalesce(m.n, op.n, 0)::INT AS n_matched,
  'https://' || source || '.example/' || p.chunk_id || CASE WHEN priority > 0 THEN '#page=1' ELSE '#:~:text=' || replace(url_encode(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:8], ' ')), '%2F', '/') END AS link
FROM p LEFT JOIN m ON m.query_id = p.query_id AND m.chunk_id = p.chunk_id LEFT JOIN op ON op.chunk_id = p.chunk_id WHERE position <= 8
"""


@query(_HYBRID)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a question against documents: vectors of even ids are chunks and of odd ids lines, and texts of the
    benchmark are searched in documents and in their lines."""
    v = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents")
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding")
    chunk_list = ranking.batch_topk(probes, v.filter("vec_id % 2 = 0"), 30).select(F.col("probe").alias("query_id"), F.col("vec_id").alias("chunk_id"), "rank")
    line_list = ranking.batch_topk(probes, v.filter("vec_id % 2 = 1"), 60).select(F.col("probe").alias("query_id"), F.col("vec_id").cast("string").alias("line_id"), (F.col("vec_id") - 1).alias("chunk_id"), "score", "rank")
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id").cast("long") * 20).alias("query_id"), "text")
    lines = corpus.lines(docs).select(F.concat_ws(":", "doc_id", "idx").alias("line_id"), F.col("doc_id").alias("chunk_id"), "idx", "line")
    texts, of_lines = corpus.matched_lines(lines.withColumn("at", F.struct("idx", "line_id")), asked, line="at")
    text_list = ranking.ranked(texts, ["query_id"], F.desc(F.round("score", 9)), "chunk_id").filter("rank <= 30").select("query_id", "chunk_id", "rank")
    line_texts = ranking.ranked(of_lines, ["query_id"], F.desc(F.round("score", 9)), "chunk_id", "at").filter("rank <= 60").select("query_id", F.col("at.line_id").alias("line_id"), "chunk_id", "score", "rank")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 3 == 0, "page").otherwise("file").alias("kind"), F.when(F.col("doc_id") % 3 == 1, "decizie").alias("doc_type"), F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias("url"), "text", F.sha1("text").alias("content_hash"), F.lit(1).alias("page"))
    out = retrieve(chunk_list, line_list, text_list, line_texts, chunks, lines)
    return out.select("query_id", "position", "chunk_id", F.round("score", 12).alias("score"), F.size("matched").alias("n_matched"), "link")


@query("""
WITH r AS (SELECT source, doc_id, text FROM documents WHERE doc_id % 3 = 0),
n AS (SELECT source, doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM documents),
a AS (SELECT source, doc_id, doc_id AS o, false AS continuation FROM r UNION ALL
  SELECT r.source, n.next, r.doc_id, true FROM r JOIN n ON n.source = r.source AND n.doc_id = r.doc_id WHERE (r.doc_id % 2 = 0 OR suffix(rtrim(r.text), ':')) AND n.next IS NOT NULL AND n.next % 3 <> 0)
SELECT source, doc_id, continuation, row_number() OVER (PARTITION BY source ORDER BY o, continuation)::INT AS place FROM a
""")
def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document as a result; those with an even id are made to end with a colon."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(": "))).otherwise(F.col("text")).alias("text"))
    results = docs.filter("doc_id % 3 = 0").select(F.col("source").alias("q"), F.col("doc_id").alias("o"), "source", "doc_id", "text")
    return continued(results, docs, "q", "o", "source", "doc_id", "text").select("source", "doc_id", "continuation", "place")


@query("SELECT doc_id, sha1(text) AS content_hash, sha1(text) IN (SELECT sha1(text) FROM documents WHERE doc_id % 2 = 0) AS reused, 64 AS dims FROM documents")
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 2 = 0").select(F.sha1("text").alias("content_hash"), F.array_repeat(F.lit(0.125).cast("float"), 64).alias("embedding"))
    return embedded(docs, old).select("doc_id", "content_hash", "reused", F.size("embedding").alias("dims"))


@query()
def contact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("site"), F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id").alias("url"), F.lit("").alias("title"))
    lines = corpus.lines(docs).select(F.col("doc_id").alias("chunk_id"), "idx", "line_id", "line")
    found = contacts.deduplicated(contacts.cards(chunks, lines))
    return found.select("contact_id", "site", "name", F.size("phone").alias("phones"), F.array_join("email", ",").alias("emails"))


@query("""
WITH u AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next, role FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}\\p{Pc}]+'), lambda x: length(x) >= 4)) AS q, list_distinct(list_filter(regexp_extract_all(lower(next), '[\\p{L}\\p{N}\\p{M}\\p{Pc}]+'), lambda x: length(x) >= 4)) AS l FROM u WHERE role = 'user' AND next IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, l)) / len(q)::DOUBLE, 9) END AS share FROM w
""".replace("\\\\", "\\"))
def question_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.next_items(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").filter("role = 'user' and next_text is not null")
    return rows.select("conv_id", "turn", F.round(questions.overlap(F.col("text"), F.col("next_text")), 9).alias("share"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1995-06-17' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_custkey % 2 = 0 THEN '1992-03-01' END AS recency FROM orders
""")
def recency_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date up to a day in texts made of orders."""
    text = F.concat(F.lit("din "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.when(F.col("o_custkey") % 2 == 0, " și 1 martie 1992").otherwise(" și 45.13.1994"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", questions.latest_date(F.col("t"), F.lit("1995-06-17")).alias("recency"))


def _case(column: str, rules: dict[str, str], fold: str = "") -> str:
    return " ".join(f"WHEN regexp_matches({column}, '{fold}{p}') THEN '{n}'" for n, p in rules.items())


@query(rf"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, html AS t FROM pages)
SELECT page_id, CASE {_case("host", questions.HOST_CATEGORIES)} {_case("t", questions.TEXT_CATEGORIES, "(?i)")} ELSE 'other' END AS category FROM h
""")
def site_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", questions.category(urls.host(F.col("url")), F.col("html"))["category"].alias("category"))


@query("""
SELECT o_custkey, url, place FROM (SELECT o_custkey, url, row_number() OVER (PARTITION BY o_custkey ORDER BY o, url)::INT AS place FROM (SELECT o_custkey, 'u' || (o_orderkey % 9) AS url, min(o_orderkey) AS o FROM orders GROUP BY ALL)) WHERE place <= 3
""")
def navigation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("u"), F.col("o_orderkey") % 9).alias("url"), "o_orderkey")
    return answers.navigation_links(o, "o_custkey", "url", "o_orderkey").select("o_custkey", "url", "place")


@query("""
SELECT o_custkey, arg_min(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1
""")
def focus_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("o"), F.when(F.col("o_orderstatus") == "F", "file").otherwise("page").alias("kind"))
    return answers.focus(o, "o_custkey", "kind", "o", "o_orderkey")
