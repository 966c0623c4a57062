"""Nearest vectors by inverted lists: vectors lie with the centroid that is nearest to them, and a search reads the lists that can matter.

Centroids are fitted on a bounded sample; every vector is put in a list. A list knows the greatest distance of a member to its centroid, its radius, so
for a probe q no member scores above q . centroid + |q| * radius. A search reads the `lists` most promising lists of each probe; in exact mode it then reads all lists
whose bound is not below the k-th score found so far, so nothing is lost.

Defined results: vectors that are null are in no list; ties go to the least key; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.ranking import _Best, _matrix
from lectern.session import checkpointed

#: Vectors of the sample that centroids are fitted on, rounds of the fit, and digits to which scores are compared.
MAX_SAMPLE, ROUNDS, DIGITS = 20_000, 12, 12
ROWS_IN_BLOCK = 4096


@dataclass(frozen=True)
class Lists:
    """The folder of the lists, their centroids and radii."""

    path: str
    centroids: np.ndarray
    radii: np.ndarray


def centroids(vectors: DataFrame, n: int, key: str = "vec_id", vector: str = "embedding", most: int = MAX_SAMPLE) -> np.ndarray:
    """At most n centroids of a sample of at most `most` vectors, those with the least hash of the key; the same in every run."""
    sample = vectors.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(key), key).limit(most)
    rows = [r["v"] for r in sample.orderBy(F.xxhash64(key), key).collect()]
    if not rows:
        return np.zeros((0, 0))
    x = np.array(rows)
    found = np.unique(x[:n], axis=0)
    for _ in range(ROUNDS):
        own = np.argmin((found**2).sum(1) - 2 * x @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(found))
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def build(vectors: DataFrame, path: str, n: int, key: str = "vec_id", vector: str = "embedding") -> Lists:
    """Write all vectors to a new folder, a subfolder for each list."""
    c = centroids(vectors, n, key, vector)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(c)
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, len(batch), ROWS_IN_BLOCK):
                part = batch.slice(at, ROWS_IN_BLOCK)
                v = _matrix(part.column(1))
                own = np.argmin((c**2).sum(1) - 2 * v @ c.T, axis=1)
                away = np.sqrt(((v - c[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.astype(np.int32)), pa.array(away)], ["key", "v", "list", "away"])

    placed = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, v array<double>, list int, away double")
    # a list of any size is spread over tasks
    placed.repartitionByRange("list", "away").sortWithinPartitions("list").write.partitionBy("list").parquet(path)
    radii = np.zeros(len(c))
    if len(c):
        for r in spark.read.parquet(path).groupBy("list").agg(F.max("away").alias("r")).collect():  # a row a centroid
            radii[r["list"]] = r["r"]
    return Lists(path, c, radii)


def _read(spark: SparkSession, index: Lists, names: pa.Array, p: np.ndarray, wanted: np.ndarray, k: int, kinds: str, floor: np.ndarray | None = None) -> DataFrame:
    """The k best that each task has among the lists that wanted (probe, list) names."""
    lists = np.flatnonzero(wanted.any(axis=0)).tolist()
    shared = spark.sparkContext.broadcast((names, p, {i: np.flatnonzero(wanted[:, i]) for i in lists}, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p, asked, floor = shared.value
        best = _Best(len(p), k, DIGITS)
        if floor is not None:
            best.floor = floor.copy()
        for batch in batches:
            own = np.asarray(batch.column(2))
            for i in np.unique(own).tolist():
                at = np.flatnonzero(own == i)
                for x in range(0, len(at), ROWS_IN_BLOCK):
                    part = batch.take(pa.array(at[x : x + ROWS_IN_BLOCK]))
                    best.scan(part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1)), p, asked[i])
        for at, keys, score, _ in best.rows():
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(keys), pa.array(score)], ["probe", "key", "score"])

    return spark.read.parquet(index.path).filter(F.col("list").isin(lists)).select("key", "v", "list").mapInArrow(run, kinds)


def topk(index: Lists, probes: DataFrame, k: int, lists: int, exact: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """probe, key, score, rank: the k best vectors of the `lists` most promising lists of each probe, or with `exact` of all.

    probes (probe, vector) are a bounded table: it goes to all tasks.
    """
    spark = probes.sparkSession
    asked = probes.filter(F.col(vector).isNotNull()).select("probe", F.col(vector).cast("array<double>").alias("v")).toArrow().combine_chunks()
    probe_kind, key_kind = (probes.schema["probe"].dataType.simpleString(), spark.read.parquet(index.path).schema["key"].dataType.simpleString() if len(index.centroids) else "long")
    kinds = f"probe {probe_kind}, key {key_kind}, score double"
    if not len(asked) or not len(index.centroids):
        return spark.createDataFrame([], kinds.replace("key ", f"{key} ") + ", rank int")
    names, p = asked["probe"].combine_chunks(), _matrix(asked["v"])
    likely = p @ index.centroids.T
    bound = likely + np.sqrt((p**2).sum(1))[:, None] * index.radii
    wanted = np.zeros(bound.shape, bool)
    np.put_along_axis(wanted, np.argsort(-likely, axis=1, kind="stable")[:, :lists], True, axis=1)
    order = Window.partitionBy("probe").orderBy(F.desc(F.round("score", DIGITS)), "key")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = _read(spark, index, names, p, wanted, k, kinds)
    if exact:
        found = checkpointed(best(found).drop("rank"))
        # the k-th score of each probe, a row a probe
        kth = {r["probe"]: r["s"] for r in found.groupBy("probe").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).collect()}
        floor = np.array([kth.get(x, -np.inf) for x in names.to_pylist()])
        more = (bound >= floor[:, None] - 1e-9) & ~wanted
        if more.any():
            found = found.unionByName(_read(spark, index, names, p, more, k, kinds, floor))
    return best(found).select("probe", F.col("key").alias(key), "score", "rank")
