"""Candidates for an answer: lists of several searches fused, the best and the newest picked, fresher acts put in between.

Questions are handled together; every step is a join or a window over question ids.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import ranking

#: Weights of the searches by question, rewrites and keywords; how many fresh acts of each kind, and of all, are taken, and after which rank.
WEIGHTS = {"question": 1.0, "question_beside_rewrite": 0.5, "ro": 1.0, "ru": 0.25, "keywords": 1.0}
TOP = 12
FRESH = {"later": 3, "newer": 2, "fresh_terms": 1}
FRESH_MOST, FRESH_AFTER = 4, 6
#: Chunks that a second round adds to a question.
SECOND_MOST = 8


def fused(lists: Mapping[str, DataFrame], rewritten: bool = True) -> DataFrame:
    """query_id, chunk_id, score, position over the lists `question`, `ro`, `ru`, `keywords` (query_id, chunk_id, rank).

    The question's own list weighs half where a Romanian rewrite stands beside it.
    """
    named = []
    for name, df in lists.items():
        weight = WEIGHTS["question_beside_rewrite"] if name == "question" and rewritten and "ro" in lists else WEIGHTS[name]
        named.append((df, weight, f"{name}_rank"))
    return ranking.by_score(ranking.rrf(named, "chunk_id", "query_id"), "query_id")


def picked(candidates: DataFrame, chunks: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` distinct contents of each question and the newest dated one below them if it is newer.

    chunks: chunk_id, content_hash, date and any other columns.
    """
    rows = candidates.select("query_id", "chunk_id", "score", "position").join(chunks, "chunk_id")
    once = F.row_number().over(Window.partitionBy("query_id", F.coalesce("content_hash", F.col("chunk_id").cast("string"))).orderBy("position"))
    distinct = rows.withColumn("_n", once).filter("_n = 1").drop("_n")
    placed = distinct.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
    return ranking.with_newest(placed, "query_id", "position", "date", top)


def refreshed(chosen: DataFrame, fresh: Mapping[str, DataFrame], about_now: DataFrame) -> DataFrame:
    """`chosen` with up to four fresh chunks after the sixth, where the answer rests on acts or the question is about now.

    fresh: lists `later`, `newer`, `fresh_terms` with the columns of `chosen` but score, position being the place in their list; about_now:
    query_id of questions about the current state. `place` is the order.
    """
    union = None
    for n, (name, df) in enumerate(fresh.items()):
        first = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
        known = chosen.select("query_id", "chunk_id")
        part = df.join(known, ["query_id", "chunk_id"], "left_anti").withColumn("_p", first).filter(F.col("_p") <= FRESH[name]).withColumn("_k", F.lit(n))
        union = part if union is None else union.unionByName(part)
    hashes = F.coalesce("content_hash", F.col("chunk_id").cast("string"))
    once = F.row_number().over(Window.partitionBy("query_id", hashes).orderBy("_k", "_p"))
    new = union.withColumn("_n", once).filter("_n = 1").drop("_n")
    old = chosen.select("query_id", hashes.alias("_h"))
    new = new.withColumn("_h", hashes).join(old, ["query_id", "_h"], "left_anti").drop("_h")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_k", "_p"))
    acts = chosen.filter("is_act").select("query_id").unionByName(about_now.select("query_id")).distinct()
    new = new.withColumn("position", place).filter(F.col("position") <= FRESH_MOST).join(acts, "query_id", "left_semi")
    columns = [c for c in chosen.columns if c != "score"]
    return ranking.interleaved(chosen.select(*columns), new.select(*columns), "query_id", "position", FRESH_AFTER)


def second_round(first: DataFrame, again: DataFrame, chunks: DataFrame, asked: DataFrame, most: int = SECOND_MOST) -> DataFrame:
    """`first` (query_id, chunk_id, position, content_hash and more), and for the questions of `asked` up to `most` chunks of a second search after them.

    again: candidates of the second search (query_id, chunk_id, position), made for the questions of `asked` only. Chunks and contents of the first round are left out,
    and of one content the best placed chunk counts. `round` tells where a chunk comes from.
    """
    hashes = F.coalesce("content_hash", F.col("chunk_id").cast("string"))
    known = first.select("query_id", "chunk_id", hashes.alias("_hash"))
    rows = again.select("query_id", "chunk_id", "position").join(asked.select("query_id").distinct(), "query_id", "left_semi")
    rows = rows.join(known.drop("_hash"), ["query_id", "chunk_id"], "left_anti").join(chunks, "chunk_id").withColumn("_hash", hashes)
    rows = rows.join(known.drop("chunk_id"), ["query_id", "_hash"], "left_anti")
    once = F.row_number().over(Window.partitionBy("query_id", "_hash").orderBy("position"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    new = rows.withColumn("_n", once).filter("_n = 1").withColumn("_p", place).filter(F.col("_p") <= most)
    last = first.groupBy("query_id").agg(F.max("position").alias("_last"))
    new = new.join(last, "query_id", "left").withColumn("position", (F.coalesce("_last", F.lit(0)) + F.col("_p")).cast(first.schema["position"].dataType))
    columns = ["query_id", "chunk_id", "position", "content_hash"]
    return first.select(*columns, F.lit(1).alias("round")).unionByName(new.select(*columns, F.lit(2).alias("round")))
