"""Corpus tools over lines: splitting, hashes, grep with context, keyword ranking, tables of contents, mentions, postings."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.stemming import index_words, plain_words
from lectern.functions.texts import lexemes, query_terms
from lectern.session import checkpointed, shared_dir

#: Asked terms that are searched in one pass.
MOST_TERMS = 200_000
#: Distinct words that a task holds before it gives them on.
MOST_WORDS = 200_000
#: What a cover of words of the lowest weight counts.
COVER = 0.1


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """key, idx (0-based among lines that are not blank), line, line_id and content_hash."""
    trimmed = F.transform(F.split(F.col(text), "\n", -1), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    cut = docs.select(key, *keep, F.posexplode_outer(F.filter(trimmed, lambda t: t != "")).alias("idx", "line")).filter("line is not null")
    return cut.withColumns({"line_id": F.sha1(F.concat_ws(":", key, "idx")), "content_hash": F.sha1("line")})


def contains(column: Column, text: str) -> Column:
    """Substring search without case; no character is a wildcard."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def contains_any(column: Column, texts: Sequence[str]) -> Column:
    low = F.lower(column)
    found = F.lit(False)
    for t in texts:
        found = found | F.contains(low, F.lower(F.lit(t)))
    return found


def dated(column: Column) -> Column:
    """Whether a text holds a run of four digits, as years do."""
    return column.rlike(r"\d{4}")


def begins_with_any(column: Column, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | column.startswith(p)
    return found


def grep(lines_: DataFrame, text: str, limit: int, key: str = "doc_id") -> DataFrame:
    """The first `limit` matching lines by key and place: a top-k, not a sort of all."""
    return lines_.filter(contains(F.col("line"), text)).orderBy(key, "idx").limit(limit)


def with_context(lines_: DataFrame, hit: Column, radius: int, key: str = "doc_id") -> DataFrame:
    """Lines within `radius` of a hit in the same document, with `gap` where lines before are left out."""
    w = Window.partitionBy(key).orderBy("idx")
    near = F.max(hit.cast("int")).over(w.rowsBetween(-radius, radius)) == 1
    shown = lines_.withColumn("is_hit", hit).withColumn("_near", near).filter("_near").drop("_near")
    before = F.lag("idx").over(w)
    return shown.withColumn("gap", before.isNotNull() & (before != F.col("idx") - 1))


def neighbours(lines_: DataFrame, hit: Column, key: str = "doc_id") -> DataFrame:
    """Each hit with the line before and the line after it."""
    w = Window.partitionBy(key).orderBy("idx")
    return lines_.withColumns({"before": F.lag("line").over(w), "after": F.lead("line").over(w)}).filter(hit)


def keyword_ranking(lines_: DataFrame, keywords: Sequence[str], most: int = 30, key: str = "doc_id") -> DataFrame:
    """Documents by how many useful keywords their lines hold; a keyword in no line or in more than `most` lines is useless.

    One pass finds all keywords; counts a keyword come from partial sums.
    """
    words = F.array(*[F.lit(k) for k in keywords])
    low = F.lower("line")
    hits = lines_.select(key, F.explode(F.filter(words, lambda w: F.contains(low, F.lower(w)))).alias("keyword"))
    per = hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("keyword")
    found = hits.join(F.broadcast(per), "keyword")  # at most as many rows as keywords
    return found.groupBy(key).agg(F.countDistinct("keyword").alias("keywords"))


def toc(chunks: DataFrame, lines_: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with the number of their lines; chunks without lines have none."""
    counts = lines_.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))
    return chunks.join(counts, key, "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def heading(section: Column, legal_path: Column, title: Column) -> Column:
    """What a table of contents calls a chunk: its section and legal path, else its title."""
    path = F.concat(F.coalesce(section, F.array().cast("array<string>")), F.coalesce(legal_path, F.array().cast("array<string>")))
    return F.when(F.size(path) > 0, F.array_join(path, " › ")).otherwise(F.coalesce(title, F.lit("")))


def opened(lines_: DataFrame, doc: object, first: int = 0, most: int = 60, key: str = "doc_id") -> DataFrame:
    """Lines of one document from a place on, in order."""
    return lines_.filter((F.col(key) == doc) & (F.col("idx") >= first)).orderBy("idx").limit(most)


def mentions(lines_: DataFrame, texts: Sequence[str], known: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The first line of each document that names one of `texts`, documents of `known` left out.

    A grouped minimum of (place, line), so no document's lines are sorted.
    """
    found = lines_.filter(contains_any(F.col("line"), texts))
    if known is not None:
        found = found.join(known.select(key).distinct(), key, "left_anti")
    best = found.groupBy(key).agg(F.min(F.struct("idx", "line")).alias("m"))
    return best.select(key, F.col("m.idx").alias("idx"), F.col("m.line").alias("line"))


def next_items(rows: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """Every row with the item that follows it in its document.

    Rows are dealt by ranges of document and order and written, so a document of any size is spread; the first rows of the ranges (one a range) tell what follows
    their last rows.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/following-{uuid.uuid4().hex}"
    rows.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    first = dealt.groupBy("_range").agg(F.min(F.struct(F.col(key).alias("k"), F.col(order).alias("o"), F.col(item).alias("x"))).alias("_f"))
    after = first.select("_range", F.lead("_f").over(Window.orderBy("_range")).alias("_after"))
    within = F.lead(F.struct(F.col(key).alias("k"), F.col(item).alias("x"))).over(Window.partitionBy("_range").orderBy(key, order))
    met = dealt.withColumn("_next", within).join(F.broadcast(after), "_range")
    follows = F.coalesce("_next", F.struct("_after.k", "_after.x"))
    return met.withColumn(f"next_{item}", F.when(follows["k"].eqNullSafe(F.col(key)), follows["x"])).select(*rows.columns, f"next_{item}")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct words of all texts, lower-cased and without accents.

    Texts are read one after another; of a batch, the distinct words so far are held, at most `MOST_WORDS` and those of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = lambda words: pa.RecordBatch.from_arrays([pa.array(list(words), pa.string())], ["word"])
        for batch in batches:
            held: set[str] = set()
            for t in batch.column(0):
                if t.is_valid:
                    held.update(plain_words(t.as_py()))
                if len(held) > MOST_WORDS:
                    yield given(held)
                    held = set()
            yield given(held)

    return docs.select(text).mapInArrow(run, "word string").distinct()


def postings(texts: DataFrame, key: str, text: str = "text", language: Column | None = None) -> DataFrame:
    """term, key, n (occurrences), first (position from 0) and length (lexemes of the text): the inverted index."""
    cut = texts.select(key, lexemes(F.col(text), language if language is not None else F.lit("ro")).alias("_l"))
    rows = cut.select(key, F.size("_l").alias("length"), F.posexplode_outer("_l").alias("_at", "term")).filter("term is not null")
    return rows.groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))


def asked_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """query, term: the distinct terms of each question by the Romanian and by the Russian rules, as it may be in either.

    A term of several words is a phrase: its words with a space between, where a word that the index leaves out is empty.
    """

    @F.pandas_udf("array<string>")
    def alternatives(terms: pd.Series) -> pd.Series:
        return pd.Series([sorted({" ".join(index_words(t, rules)).strip() for t in ts for rules in ("ro", "ru")} - {""}) if ts is not None else [] for ts in terms], dtype=object)

    return queries.select(query, F.explode(alternatives(query_terms(F.col(text)))).alias("term"))


def covers(ends: Sequence[tuple[int, int]]) -> int:
    """The number of minimal covers among occurrences (end, begin): each is the first to end at or after a place, from its last beginning; the next begins after it."""
    n, last = 0, -1
    for end, back in sorted((end, -begin) for end, begin in ends):
        if -back > last:
            n, last = n + 1, -back
    return n


class _Asked:
    """Asked terms, single words and phrases, and the questions that ask for each."""

    def __init__(self, terms: Sequence[str], askers: Sequence[Sequence[int]]):
        self.single: dict[str, int] = {}
        self.phrases: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        self.askers = [np.array(q, np.int64) for q in askers]
        self.terms: dict[int, list[int]] = {}
        for i, t in enumerate(terms):
            words = tuple(t.split(" "))
            if len(words) == 1:
                self.single[t] = i
            else:
                self.phrases.setdefault(words[0], []).append((words, i))
            for q in askers[i]:
                self.terms.setdefault(q, []).append(i)

    def found(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, and for each the terms found and the covers."""
        counts = Counter(words)
        hits = {self.single[w]: n for w, n in counts.items() if w in self.single}
        ends: dict[int, list[tuple[int, int]]] = {}
        if not self.phrases.keys().isdisjoint(counts):
            for i, w in enumerate(words):
                for term, t in self.phrases.get(w, ()):
                    if len(words) >= i + len(term) and all(x in ("", y) for x, y in zip(term, words[i:], strict=False)):
                        ends.setdefault(t, []).append((i + len(term) - 1, i))
        hits |= {t: len(e) for t, e in ends.items()}
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        asked = [self.askers[t] for t in hits]
        q = np.concatenate(asked)
        terms = np.bincount(q)
        total = np.bincount(q, np.repeat(list(hits.values()), [len(x) for x in asked])).astype(np.int64)
        if ends:  # words of a phrase may be asked for by themselves
            places: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
            own = {t: w for w, t in self.single.items() if t in hits}
            for x in np.unique(np.concatenate([self.askers[t] for t in ends])).tolist():
                mine = [e for t in self.terms[x] if t in hits for e in (ends[t] if t in ends else [(i, i) for i in places[own[t]]])]
                total[x] = covers(mine)
        at = np.flatnonzero(terms)
        return at, terms[at], total[at]


def matched(texts: DataFrame, queries: DataFrame, key: str | Sequence[str], query: str = "query_id", text: str = "text", language: Column | None = None, most_terms: int = MOST_TERMS) -> DataFrame:
    """query, key, terms (distinct query terms found), score: texts that hold any term of a query, ranked by cover density.

    A question's terms are alternatives, so every minimal cover is one occurrence of a term that holds no other, and counts COVER. Asked terms go to all tasks, at most
    `most_terms` at a time: questions beyond that are searched in further passes over the texts. A text never leaves its task, only what is found in it.
    """
    spark = texts.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    asked = checkpointed(asked_terms(queries, query))
    passes = max(1, -(-asked.count() // most_terms))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = ", ".join([f"{query} {kind(queries, query)}", *(f"{k} {kind(texts, k)}" for k in keys), "terms long", "score double"])
    rows = texts.select(*keys, F.col(text).alias("_text"), (language if language is not None else F.lit("ro")).alias("_lang"))
    out = None
    for i in range(passes):
        part = asked.filter(F.pmod(F.xxhash64(query), F.lit(passes)) == i).toArrow()
        names, codes = _coded(part["term"])
        ids, asker = _coded(part[query])
        askers = [[] for _ in names]
        for t, q in zip(codes, asker, strict=True):
            askers[t].append(q)
        shared = spark.sparkContext.broadcast((names.to_pylist(), askers, ids))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, askers, ids = shared.value
            index = _Asked(terms, askers)
            for batch in batches:
                none = np.zeros(0, np.int64)
                found, at = [(none, none, none)], [none]
                for row, (t, lang) in enumerate(zip(batch.column("_text"), batch.column("_lang"), strict=True)):
                    if t.is_valid:
                        found.append(index.found(index_words(t.as_py(), lang.as_py())))
                        at.append(np.full(len(found[-1][0]), row))
                qs, ns, cs = (np.concatenate([x[k] for x in found]) for k in range(3))
                rows_of = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(qs)), *(batch.column(k).take(rows_of) for k in keys), pa.array(ns), pa.array(cs * COVER)], [query, *keys, "terms", "score"])

        here = rows.mapInArrow(run, schema)
        out = here if out is None else out.unionByName(here)
    return out


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, list[int]]:
    """Distinct values, and the place among them of each."""
    whole = column.combine_chunks().dictionary_encode()
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    return whole.dictionary, whole.indices.to_pylist()


def matched_lines(lines_: DataFrame, queries: DataFrame, key: str = "chunk_id", line: str = "line_id", text: str = "line", query: str = "query_id", language: Column | None = None, most_terms: int = MOST_TERMS) -> tuple[DataFrame, DataFrame]:
    """Full-text search in lines and in what they make up, in one pass over the lines: (query, key, score) and (query, key, line, score).

    What is found in lines is written once; a text's covers are those of its lines.
    """
    path = f"{shared_dir(lines_.sparkSession)}/hits-{uuid.uuid4().hex}"
    matched(lines_, queries, [key, line], query, text, language, most_terms).write.parquet(path)
    hits = lines_.sparkSession.read.parquet(path)
    return hits.groupBy(query, key).agg(F.sum("score").alias("score")), hits.select(query, key, line, "score")
