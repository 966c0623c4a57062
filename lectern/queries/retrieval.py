"""Vector and full-text retrieval, fusion, corpus tools."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import texts
from lectern.functions.stemming import RU_STOP_WORDS
from lectern.functions.vectors import mean
from lectern.operators import corpus, inverted, ranking, trigrams
from lectern.plans import gather
from lectern.queries.stems_sql import WORDS, density, romanian, russian
from lectern.registry import query
from lectern.session import checkpointed, shared_dir, table


def _probe(vectors: DataFrame, vec_id: int) -> list[float]:
    row = vectors.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


_SCORED = "SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {}) p"


@query(f"SELECT vec_id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM ({_SCORED.format(0)}) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return ranking.vector_topk(v, _probe(v, 0), 10).withColumn("score", F.round("score", 9))


@query(f"SELECT vec_id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM ({_SCORED.format(1)}) WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return ranking.vector_topk(v, _probe(v, 1), 10, label=[1, 3, 5], site=None).withColumn("score", F.round("score", 9))


_NEAREST = """
SELECT probe, vec_id, round(score, 9) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY probe ORDER BY round(score, 12) DESC, vec_id)::INT AS rank
  FROM (SELECT p.vec_id AS probe, e.vec_id, list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings p WHERE p.vec_id % 20 = 0)
) WHERE rank <= 5
"""


@query(_NEAREST)
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding")
    return ranking.batch_topk(probes, v, 5).withColumn("score", F.round("score", 9))


@query(_NEAREST)
def vector_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by inverted lists: the eight most promising lists of each probe, then those whose bound can matter."""
    v = table(spark, sf_dir, "embeddings")
    index = inverted.build(v, f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}", 32)
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding")
    return inverted.topk(index, probes, 5, 8, exact=True).withColumn("score", F.round("score", 9))


_RANKED = "SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({}) ORDER BY score DESC, vec_id LIMIT {}"


@query(f"""
WITH a AS ({_RANKED.format(_SCORED.format(0), 30)}), b AS ({_RANKED.format(_SCORED.format(1), 60)}),
u AS (SELECT vec_id, rank, 1.0::DOUBLE AS w, 0 AS place FROM a UNION ALL SELECT vec_id, rank, 0.1::DOUBLE, 1 FROM b),
f AS (SELECT vec_id, list_sum(list(w / (60 + rank) ORDER BY place)) AS score, min(CASE WHEN place = 0 THEN rank END)::INT AS vec_rank, min(CASE WHEN place = 1 THEN rank END)::INT AS fts_rank, min(place * 1000000 + rank) AS o FROM u GROUP BY vec_id)
SELECT vec_id, round(score, 12) AS score, vec_rank, fts_rank, row_number() OVER (ORDER BY score DESC, o)::INT AS position FROM f
""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    lists = [(ranking.vector_topk(v, _probe(v, 0), 30), 1.0, "vec_rank"), (ranking.vector_topk(v, _probe(v, 1), 60), 0.1, "fts_rank")]
    return ranking.by_score(ranking.rrf(lists, "vec_id")).withColumn("score", F.round("score", 12))


@query("""
SELECT hash, doc_id, n_chars, priority, score FROM (
  SELECT sha1(text) AS hash, d.doc_id, n_chars, coalesce(quality + 1, 0)::INT AS priority, max(n_chars::BIGINT) OVER (PARTITION BY sha1(text)) AS score,
         row_number() OVER (PARTITION BY sha1(text) ORDER BY coalesce(quality + 1, 0) DESC, n_chars DESC, d.doc_id) AS n
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
) WHERE n = 1
""")
def dedup_by_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select(F.sha1("text").alias("hash"), "doc_id", "n_chars", F.coalesce(F.col("quality") + 1, F.lit(0)).cast("int").alias("priority"), F.col("n_chars").cast("long").alias("score"))
    return ranking.deduplicated(rows, ["hash"], F.col("priority"), "score", "doc_id")


@query("SELECT min(doc_id) AS doc_id, sha1(text) AS hash FROM documents GROUP BY sha1(text)")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("hash"))
    return ranking.first_wins(docs, F.coalesce(F.col("hash"), F.col("doc_id").cast("string")), "doc_id").select("doc_id", "hash")


_LINES = r"""lines AS (
  SELECT doc_id, source, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS idx, line
  FROM (SELECT doc_id, source, i, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents), LATERAL unnest(range(1, len(parts) + 1)) AS u(i)) WHERE line <> ''
)"""


@query(f"WITH {_LINES} SELECT doc_id, idx, sha1(line) AS content_hash, sha1(doc_id || ':' || idx) AS line_id, length(line)::INT AS n FROM lines")
def lines_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(table(spark, sf_dir, "documents")).select("doc_id", "idx", "content_hash", "line_id", F.length("line").alias("n"))


@query(f"WITH {_LINES} SELECT sha1(line) AS content_hash, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY 1")
def line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.lines(table(spark, sf_dir, "documents"))
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"WITH {_LINES} SELECT doc_id, idx, line FROM lines WHERE contains(lower(line), 'license') ORDER BY doc_id, idx LIMIT 20")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.grep(corpus.lines(table(spark, sf_dir, "documents")), "LICENSE", 20).select("doc_id", "idx", "line")


@query(f"""
WITH {_LINES}, n AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, line, before, after FROM n WHERE contains(lower(line), 'token =')
""")
def grep_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = corpus.neighbours(corpus.lines(table(spark, sf_dir, "documents")), corpus.contains(F.col("line"), "token ="))
    return hits.select("doc_id", "idx", "line", "before", "after")


_WORDS = ["license", "token =", "@mail", "the", "copyright", "nowhere at all"]


@query(f"""
WITH {_LINES}, hits AS (SELECT DISTINCT doc_id, idx, k FROM lines, (SELECT unnest({_WORDS}) AS k) WHERE contains(lower(line), k)),
useful AS (SELECT k FROM hits GROUP BY k HAVING count(*) <= 30)
SELECT doc_id, count(DISTINCT k) AS keywords FROM hits JOIN useful USING (k) GROUP BY doc_id
""")
def keyword_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keyword_ranking(corpus.lines(table(spark, sf_dir, "documents")), _WORDS)


@query(f"WITH {_LINES} SELECT d.doc_id, d.source, d.lang, count(l.idx) AS n_lines FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id GROUP BY ALL")
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return corpus.toc(docs.select("doc_id", "source", "lang"), corpus.lines(docs), "doc_id")


@query(f"WITH {_LINES} SELECT doc_id, idx, line FROM lines WHERE doc_id = 7 AND idx >= 2 ORDER BY idx LIMIT 60")
def open_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.opened(corpus.lines(table(spark, sf_dir, "documents")), 7, 2).select("doc_id", "idx", "line")


@query(f"""
WITH {_LINES} SELECT doc_id, min(idx)::INT AS idx, arg_min(line, idx) AS line FROM lines
WHERE (contains(lower(line), 'license') OR contains(lower(line), 'copyright')) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id
""")
def later_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").filter("quality = 0")
    return corpus.mentions(corpus.lines(table(spark, sf_dir, "documents")), ["License", "Copyright"], known)


@query(f"""
WITH {_LINES}, h AS (SELECT *, contains(lower(line), 'license') AS is_hit FROM lines),
n AS (SELECT *, max(is_hit::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h)
SELECT doc_id, idx, line, is_hit, coalesce(lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) <> idx - 1, false) AS gap FROM n WHERE near = 1
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.lines(table(spark, sf_dir, "documents")).select("doc_id", "idx", "line")
    return corpus.with_context(rows, corpus.contains(F.col("line"), "license"), 2)


@query(f"""
WITH {_LINES}, t AS (SELECT item_id, lower(substr(text, 4, (1 + item_id % 12)::INT)) AS t FROM benchmark)
SELECT * EXCLUDE n FROM (SELECT item_id, doc_id, idx, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, idx) AS n FROM lines JOIN t ON t <> '' AND contains(lower(line), t)) WHERE n <= 50
""")
def indexed_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of each benchmark item, of one to twelve characters, in the lines of all documents, by an index: its first fifty lines."""
    path = f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}"
    trigrams.build(corpus.lines(table(spark, sf_dir, "documents")), path)
    pieces = table(spark, sf_dir, "benchmark").select("item_id", F.substring(F.col("text"), F.lit(4), (1 + F.col("item_id") % 12).cast("int")).alias("text"))
    return trigrams.search(spark, path, pieces, 50, name="item_id").select("item_id", "doc_id", "idx")


#: Terms of the items of the benchmark.
_ASKED = r"""q AS (SELECT item_id, list_filter(list_transform(string_split_regex(trim(text), '\s+'), lambda t: regexp_replace(regexp_replace(t, '[&|!()\\:*''"]', '', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda t: length(t) >= 3 AND lower(t) NOT IN ('cat','cât','cum','unde','care','pentru','este','sunt','cine','cand','când','daca','dacă','acest','aceasta','aceste','acesti','acești')) AS t FROM benchmark),
qw AS (SELECT item_id, k, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS j, len(w) AS n FROM (SELECT item_id, k, %s AS w FROM (SELECT item_id, unnest(t) AS x, generate_subscripts(t, 1) AS k FROM q)))""" % WORDS.format("x")
#: Each word by the Romanian rules, and as it is, as the Russian ones leave Latin words; a term is its words with spaces.
_TERMS = """
alts AS (SELECT DISTINCT item_id, term, unnest(string_split(term, ' ')) AS word, generate_subscripts(string_split(term, ' '), 1) - 1 AS j, n FROM (
  SELECT item_id, k, any_value(n) AS n, string_agg(s, ' ' ORDER BY j) AS term FROM qw JOIN stems USING (w) GROUP BY item_id, k UNION ALL SELECT item_id, k, any_value(n), string_agg(w, ' ' ORDER BY j) FROM qw GROUP BY item_id, k))"""


@query(f"""
WITH {_ASKED},
toks AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents)),
vocabulary AS (SELECT w FROM toks UNION SELECT w FROM qw), {romanian("vocabulary", "stems")}, {_TERMS},
t AS (SELECT doc_id, pos, s FROM toks JOIN stems USING (w)), {density("t", "alts", "doc_id")}
SELECT item_id, doc_id, terms, round(0.1::DOUBLE * covers, 6) AS score FROM found
""")
def postings_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search of the benchmark's items in all documents, by number of terms and by cover density."""
    found = corpus.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", language=F.col("lang"))
    return found.select("item_id", "doc_id", "terms", F.round("score", 6).alias("score"))


@query(f"""
WITH toks AS (SELECT doc_id, unnest({WORDS.format("text")}) AS w FROM documents), {romanian("toks", "stems")}
SELECT s AS term, count(*) AS occurrences, count(DISTINCT doc_id) AS texts FROM toks JOIN stems USING (w) GROUP BY s
""")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the inverted index of all documents."""
    index = corpus.postings(table(spark, sf_dir, "documents"), "doc_id", language=F.col("lang"))
    return index.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("texts"))


@query(f"""
WITH words AS (SELECT DISTINCT translate(unnest({WORDS.format("text")}), 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхийклмнопярстувшыьюя') AS w FROM documents), {russian("words", "stems")}
SELECT w AS word, s AS stem FROM stems WHERE s <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in sorted(RU_STOP_WORDS))})
""")
def russian_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents in Cyrillic letters, and their stems by the Russian rules."""
    words = corpus.vocabulary(table(spark, sf_dir, "documents")).select(F.translate("word", "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшыьюя").alias("word")).distinct()
    return words.select("word", F.explode(F.slice(texts.lexemes(F.col("word"), F.lit("ru")), 1, 1)).alias("stem"))


@query("SELECT doc_id, source, n_chars, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_doc_id FROM documents")
def next_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.next_items(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "doc_id")


@query("""
SELECT probe, vec_id, position FROM (
  SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, vec_id)::INT AS position
  FROM (SELECT p.vec_id AS probe, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) + CASE WHEN e.label = p.label THEN 0.05 ELSE 0 END AS score FROM embeddings e, embeddings p WHERE p.vec_id % 20 = 0 AND e.vec_id % 20 <> 0)
  WHERE score >= 0.3
) WHERE position <= 2
""")
def nearest_with_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows with a bonus for one label, above a threshold, two a probe."""
    v = table(spark, sf_dir, "embeddings")
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding", "label")
    out = ranking.boosted_topk(probes, v.filter("vec_id % 20 <> 0"), 2, "label", 0.05, 0.3)
    return out.select("probe", "vec_id", F.col("rank").alias("position"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def top_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return ranking.ranked(docs, ["source"], F.desc("n_chars"), "doc_id").filter("rank <= 3").select("source", "doc_id")


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS position, turn AS date FROM conversations),
k AS (SELECT *, max(CASE WHEN position <= 2 THEN date END) OVER (PARTITION BY conv_id) AS kept, max(CASE WHEN position > 2 THEN date END) OVER (PARTITION BY conv_id) AS late FROM r)
SELECT conv_id, turn, position::INT AS position FROM k WHERE position <= 2 OR (date = late AND date > kept)
""")
def newest_below_the_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    rows = ranking.ranked(talks, ["conv_id"], F.desc("n"), "turn").withColumnRenamed("rank", "position").withColumn("date", F.col("turn"))
    return ranking.with_newest(rows, "conv_id", "position", "date", 2).select("conv_id", "turn", "position")


@query("""
SELECT label, any_value(n) AS n, list_sum(list(x ORDER BY i)) AS squares FROM (
  SELECT label, i, round(avg(embedding[i + 1]::DOUBLE) * avg(embedding[i + 1]::DOUBLE), 9) AS x, count(*) AS n FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY label, i
) GROUP BY label
""")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, as the rounded squares of its elements summed."""
    v = table(spark, sf_dir, "embeddings").groupBy("label").agg(mean(F.col("embedding"), 64).alias("c"), F.count(F.lit(1)).alias("n"))
    return v.select("label", "n", F.aggregate(F.transform("c", lambda x: F.round(x * x, 9)), F.lit(0.0), lambda s, x: s + x).alias("squares"))


_LIST = "SELECT p.vec_id AS query_id, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank FROM embeddings e, embeddings p WHERE p.vec_id % 20 = 0 AND e.vec_id % 4 = {}"


@query(f"""
WITH u AS (SELECT *, 0.5::DOUBLE AS w, 0 AS place FROM ({_LIST.format(1)}) WHERE rank <= 10 UNION ALL SELECT *, 1.0::DOUBLE, 1 FROM ({_LIST.format("1 - 1")}) WHERE rank <= 10 UNION ALL SELECT *, 0.25::DOUBLE, 2 FROM ({_LIST.format("1 AND e.label < 5")}) WHERE rank <= 10),
f AS (SELECT query_id, chunk_id, list_sum(list(w / (60 + rank) ORDER BY place)) AS score, min(place * 1000000 + rank) AS o FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS position FROM f),
j AS (SELECT r.*, n_chars AS date, row_number() OVER (PARTITION BY query_id, sha1(text) ORDER BY position) AS copy FROM r JOIN documents ON doc_id = chunk_id),
d AS (SELECT query_id, chunk_id, date, row_number() OVER (PARTITION BY query_id ORDER BY position)::INT AS position FROM j WHERE copy = 1),
k AS (SELECT *, max(CASE WHEN position <= 12 THEN date END) OVER (PARTITION BY query_id) AS kept, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN position > 12 THEN date END DESC NULLS LAST, position) AS newest FROM d)
SELECT query_id, chunk_id, position FROM k WHERE position <= 12 OR (newest = 1 AND date > kept)
""")
def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches for every twentieth vector, fused by the weights of question and rewrites, the best and the newest picked; lengths stand in for dates."""
    v = table(spark, sf_dir, "embeddings")
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding")
    found = lambda cond: ranking.batch_topk(probes, v.filter(cond), 10).select(F.col("probe").alias("query_id"), F.col("vec_id").alias("chunk_id"), "rank")
    lists = {"question": found("vec_id % 4 = 1"), "ro": found("vec_id % 4 = 0"), "ru": found("vec_id % 4 = 1 and label < 5")}
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha1("text").alias("content_hash"), F.col("n_chars").alias("date"))
    return gather.picked(gather.fused(lists), chunks).select("query_id", "chunk_id", "position")


_FIRST = f"""u AS (SELECT *, 0.5::DOUBLE AS w, 0 AS place FROM ({_LIST.format(1)}) WHERE rank <= 10 UNION ALL SELECT *, 1.0::DOUBLE, 1 FROM ({_LIST.format("1 - 1")}) WHERE rank <= 10),
f AS (SELECT query_id, chunk_id, list_sum(list(w / (60 + rank) ORDER BY place)) AS score, min(place * 1000000 + rank) AS o FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS position FROM f),
j AS (SELECT r.*, n_chars AS date, sha1(text) AS hash, row_number() OVER (PARTITION BY query_id, sha1(text) ORDER BY position) AS copy FROM r JOIN documents ON doc_id = chunk_id),
d AS (SELECT query_id, chunk_id, date, hash, row_number() OVER (PARTITION BY query_id ORDER BY position)::INT AS position FROM j WHERE copy = 1),
k AS (SELECT *, max(CASE WHEN position <= 12 THEN date END) OVER (PARTITION BY query_id) AS kept, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN position > 12 THEN date END DESC NULLS LAST, position) AS newest FROM d),
chosen AS (SELECT * FROM k WHERE position <= 12 OR (newest = 1 AND date > kept))"""


def _first_round(spark: SparkSession, sf_dir: str) -> tuple[Callable[..., DataFrame], DataFrame, DataFrame]:
    """Searches by a part of the vectors, chunks, and the first round for every twentieth vector."""
    v = table(spark, sf_dir, "embeddings")
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding")

    def found(cond: str, most: int = 10, asked: DataFrame | None = None) -> DataFrame:
        own = probes if asked is None else probes.join(asked.select(F.col("query_id").alias("probe")), "probe", "left_semi")
        return ranking.batch_topk(own, v.filter(cond), most).select(F.col("probe").alias("query_id"), F.col("vec_id").alias("chunk_id"), "rank")

    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha1("text").alias("content_hash"), F.col("n_chars").alias("date"), (F.col("doc_id") % 3 == 1).alias("is_act"))
    return found, chunks, gather.picked(gather.fused({"question": found("vec_id % 4 = 1"), "ro": found("vec_id % 4 = 0")}), chunks)


@query(f"""
WITH {_FIRST}, asked AS (SELECT query_id FROM chosen WHERE position = 1 AND date < 1500),
u2 AS (SELECT *, 0.5::DOUBLE AS w, 0 AS place FROM ({_LIST.format(2)}) WHERE rank <= 10 UNION ALL SELECT *, 1.0::DOUBLE, 1 FROM ({_LIST.format(3)}) WHERE rank <= 10),
f2 AS (SELECT query_id, chunk_id, list_sum(list(w / (60 + rank) ORDER BY place)) AS score, min(place * 1000000 + rank) AS o FROM u2 WHERE query_id IN (SELECT query_id FROM asked) GROUP BY ALL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS position FROM f2),
j2 AS (SELECT r2.*, row_number() OVER (PARTITION BY query_id, sha1(text) ORDER BY position) AS copy FROM r2 JOIN documents ON doc_id = chunk_id WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.query_id = r2.query_id AND (c.chunk_id = r2.chunk_id OR c.hash = sha1(text)))),
n2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM j2 WHERE copy = 1)
SELECT query_id, chunk_id, position, 1 AS round FROM chosen UNION ALL
SELECT query_id, chunk_id, (n + (SELECT max(position) FROM chosen c WHERE c.query_id = n2.query_id))::INT, 2 FROM n2 WHERE n <= 8
""")
def gathered_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second search for the questions whose first source is short, its chunks after those of the first round."""
    found, chunks, first = _first_round(spark, sf_dir)
    first = checkpointed(first)
    asked = first.filter("position = 1 and date < 1500").select("query_id")
    again = gather.fused({"question": found("vec_id % 4 = 2", asked=asked), "ro": found("vec_id % 4 = 3", asked=asked)})
    return gather.second_round(first, again, chunks, asked).select("query_id", "chunk_id", "position", "round")


@query(f"""
WITH {_FIRST}, lists AS (SELECT *, 0 AS k, 3 AS most FROM ({_LIST.format(2)}) WHERE rank <= 6 UNION ALL SELECT *, 1, 2 FROM ({_LIST.format(3)}) WHERE rank <= 6 UNION ALL SELECT *, 2, 1 FROM ({_LIST.format("1 AND e.label < 5")}) WHERE rank <= 6),
l AS (SELECT lists.*, sha1(text) AS hash, row_number() OVER (PARTITION BY query_id, k ORDER BY rank) AS p FROM lists JOIN documents ON doc_id = chunk_id WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.query_id = lists.query_id AND c.chunk_id = lists.chunk_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, hash ORDER BY k, p) AS copy FROM l WHERE p <= most),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, p) AS position FROM o WHERE copy = 1 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.query_id = o.query_id AND c.hash = o.hash)),
m AS (SELECT query_id, chunk_id, 1 AS part, position FROM n WHERE position <= 4 AND (query_id % 3 = 0 OR query_id IN (SELECT query_id FROM chosen WHERE chunk_id % 3 = 1))
  UNION ALL SELECT query_id, chunk_id, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY position) <= 6 THEN 0 ELSE 2 END, position FROM chosen)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY part, position)::INT AS place FROM m
""")
def refreshed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh acts of three further searches among the sources of the first round; every third question asks about now."""
    found, chunks, first = _first_round(spark, sf_dir)
    first = checkpointed(first)
    listed = lambda cond: found(cond, 6).withColumnRenamed("rank", "position").join(chunks, "chunk_id")
    fresh = {"later": listed("vec_id % 4 = 2"), "newer": listed("vec_id % 4 = 3"), "fresh_terms": listed("vec_id % 4 = 1 and label < 5")}
    return gather.refreshed(first, fresh, first.filter("query_id % 3 = 0").select("query_id").distinct()).select("query_id", "chunk_id", F.col("place").cast("int").alias("place"))
