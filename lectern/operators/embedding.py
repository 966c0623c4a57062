"""Embeddings with reuse: only distinct texts that no cache row has are embedded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.corpus import next_items

DIMENSIONS = 64


def hashing_embedder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors from signed hashes of words and their letters in threes: a stand-in that needs no model."""
    import zlib

    out = np.zeros((len(texts), dimensions))
    for i, t in enumerate(texts):
        for word in t.lower().split():
            for gram in [word, *(word[j : j + 3] for j in range(max(0, len(word) - 2)))]:
                h = zlib.crc32(gram.encode())
                out[i, h % dimensions] += 1 if h & 0x10000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(rows: DataFrame, cache: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashing_embedder, text: str = "text") -> DataFrame:
    """`rows` with content_hash, embedding and reused.

    cache: content_hash, embedding. Missing texts are embedded once each, in batches of like length; vectors then join back by hash.
    """
    hashed = rows.withColumn("content_hash", F.sha1(F.col(text)))
    known = cache.groupBy("content_hash").agg(F.min("embedding").alias("_cached"))
    missing = hashed.select("content_hash", text).join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.min(text).alias("_t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = embed(frame["_t"].fillna("").tolist())
            yield pd.DataFrame({"content_hash": frame["content_hash"], "_new": list(np.asarray(vectors, np.float32))})

    fresh = missing.repartition("content_hash").sortWithinPartitions(F.length("_t")).mapInPandas(run, "content_hash string, _new array<float>")
    both = hashed.join(known, "content_hash", "left").join(fresh, "content_hash", "left")
    return both.withColumn("reused", F.col("_cached").isNotNull()).withColumn("embedding", F.coalesce("_cached", "_new")).drop("_cached", "_new")


def continued(results: DataFrame, chunks: DataFrame, query: str, order: str, doc: str, position: str, text: str) -> DataFrame:
    """Results of each question with the next chunk of a document put in after one that ends with a colon, unless it is a result already."""
    items = chunks.select(doc, position, F.struct(position, text).alias("_item"))
    following = next_items(items, doc, position, "_item").select(doc, position, F.col("next__item").alias("_next"))
    base = results.withColumn("continuation", F.lit(False)).withColumn("_half", F.lit(0))
    more = results.filter(F.rtrim(text).endswith(":")).join(following, [doc, position]).filter("_next is not null")
    more = more.select(query, order, doc, F.col(f"_next.{position}").alias(position), F.col(f"_next.{text}").alias(text), F.lit(True).alias("continuation"), F.lit(1).alias("_half"))
    fresh = more.join(results.select(query, doc, position), [query, doc, position], "left_anti")
    place = F.row_number().over(Window.partitionBy(query).orderBy(order, "_half"))
    return base.select(query, order, doc, position, text, "continuation", "_half").unionByName(fresh).withColumn("place", place).drop("_half")
