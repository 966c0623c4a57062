"""Hybrid retrieval for many questions at once: ranked lists are fused on ids, and rows are fetched once at the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.urls import deep_link
from lectern.operators import ranking


@dataclass(frozen=True)
class Weights:
    vector: float = 1.0
    line: float = 1.0
    text: float = 0.1


def best_lines(line_vectors: DataFrame, line_texts: DataFrame, most: int = 3) -> DataFrame:
    """query_id, chunk_id and its matched lines: lines of the vector list before those of the text list, a line once, the best `most` by score.

    Both hold query_id, line_id, chunk_id, score and rank. Scores of both kinds are compared as they are.
    """
    both = line_vectors.withColumn("_list", F.lit(0)).unionByName(line_texts.withColumn("_list", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("query_id", "line_id").orderBy("_list", "rank"))
    once = both.withColumn("_n", first).filter("_n = 1").withColumn("score", F.round("score", 4))
    place = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "_list", "rank"))
    top = once.withColumn("_p", place).filter(F.col("_p") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_p", "line_id", "score"))), lambda x: F.struct(x["line_id"].alias("line_id"), x["score"].alias("score")))
    return top.groupBy("query_id", "chunk_id").agg(lines.alias("matched"))


def chunk_ranking(line_vectors: DataFrame) -> DataFrame:
    """Chunks in the order in which their first line appears in the vector list."""
    first = line_vectors.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("_r"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "chunk_id"))).drop("_r")


def retrieve(chunk_vectors: DataFrame, line_vectors: DataFrame, chunk_texts: DataFrame, line_texts: DataFrame, chunks: DataFrame, lines: DataFrame, k: int = 8, candidates: int = 30, weights: Weights = Weights()) -> DataFrame:  # noqa: B008
    """query_id, position and the best k chunks of every question with their matched lines and links.

    chunk lists: query_id, chunk_id, rank; line lists: query_id, line_id, chunk_id, score, rank; chunks: chunk_id, kind, doc_type, url, text,
    content_hash, page; lines: line_id, chunk_id, idx, line. Text hits on lines add matched lines but no rank. A chunk found by any list gets its row
    from `chunks`; copies of a content are one result, official acts before other files before pages, with the best score of the copies.
    """
    fused = ranking.rrf([(chunk_vectors, weights.vector, "vec_rank"), (chunk_ranking(line_vectors), weights.line, "line_rank"), (chunk_texts, weights.text, "fts_rank")], "chunk_id", "query_id")
    # only hashes and priorities go through the windows; texts are fetched for the chosen rows
    narrow = chunks.select("chunk_id", F.coalesce("content_hash", F.sha1("text"), F.col("chunk_id").cast("string")).alias("_hash"), ranking.kind_priority(F.col("kind"), F.col("doc_type")).alias("_priority"))
    rows = fused.join(narrow, "chunk_id")
    order = Window.partitionBy("query_id", "_hash").orderBy(F.desc("_priority"), F.desc("score"), "_first")
    best = rows.withColumn("_best", F.max("score").over(Window.partitionBy("query_id", "_hash"))).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_best"), "_first"))
    top = best.withColumn("position", place).filter(F.col("position") <= min(k, candidates)).drop("score").withColumnRenamed("_best", "score")
    matched = best_lines(line_vectors, line_texts)
    found = top.join(matched, ["query_id", "chunk_id"], "left")
    # chunks without a matched line show their first three
    bare = found.filter("matched is null").select("chunk_id").distinct()
    opening = lines.filter("idx < 3").join(bare, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line_id"))), lambda x: F.struct(x["line_id"].alias("line_id"), F.lit(0.0).alias("score"))).alias("_opening"))
    full = found.join(opening, "chunk_id", "left").join(chunks.select("chunk_id", "url", "kind", "text", "page"), "chunk_id")
    return full.select("query_id", "position", "chunk_id", "score", "vec_rank", "line_rank", "fts_rank", F.coalesce("matched", "_opening", F.array().cast("array<struct<line_id:string,score:double>>")).alias("matched"), deep_link(F.col("url"), F.col("kind"), F.col("text"), F.col("page")).alias("link"))
