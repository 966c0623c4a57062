"""Rankings: vector top-k, weighted reciprocal rank fusion, de-duplication, first-wins and order rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import dot
from lectern.session import checkpointed

RRF_K = 60
VECTORS_IN_BLOCK = 2048
#: Numbers of probes that go to all tasks at a time (32 MB), or places for what a task finds for them (70 MB).
MOST_PROBES = 4 << 20
#: Scores that a task computes at a time (8 MB), and rows that it gives at a time.
CELLS, ROWS_OUT = 1 << 20, 1 << 16


def filtered(df: DataFrame, **wanted: object) -> DataFrame:
    """Optional filters: None or an empty list leaves all rows; a list means one of; a name ending in _after means greater. Each is a
    plain predicate, so it reaches the scan."""
    for name, value in wanted.items():
        if value is None or (isinstance(value, (list, tuple, set)) and not value):
            continue
        if name.endswith("_after"):
            df = df.filter(F.col(name.removesuffix("_after")) > value)
        elif isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(name).isin(list(value)))
        else:
            df = df.filter(F.col(name) == value)
    return df


def vector_topk(vectors: DataFrame, probe: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding", **wanted: object) -> DataFrame:
    """key, score, rank of the k rows with the largest dot product; only key and vector are read, other columns join later."""
    rows = filtered(vectors, **wanted).filter(F.col(vector).isNotNull())
    scored = rows.select(key, dot(F.col(vector), F.array(*[F.lit(float(x)) for x in probe])).alias("score"))
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def batch_topk(probes: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", most_probes: int = MOST_PROBES) -> DataFrame:
    """probe, key, score, rank: the k best rows for every probe (probe, vector), exactly.

    Vectors stay where they are read: probes go to all tasks (at most `most_probes` numbers, or k places each, at a time, further ones in further passes over the vectors), a task keeps the k
    best rows of each probe over all its batches, and a last window takes the best of the tasks. Scores are compared to twelve digits, ties go to the least key.
    """
    order = Window.partitionBy("probe").orderBy(F.desc(F.round("score", 12)), key)
    return _best_of_tasks(probes, vectors, k, key, vector, most_probes, 12).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def boosted_topk(probes: DataFrame, vectors: DataFrame, k: int, label: str, bonus: float, least: float, key: str = "vec_id", vector: str = "embedding", most_probes: int = MOST_PROBES) -> DataFrame:
    """probe, key, score, rank: the k best rows for every probe (probe, vector, label), exactly, where rows of the probe's label have a bonus; none scores below `least`.

    The bonus is added before a task chooses, so no row is left out before it counts. Scores are rounded to nine digits before the bonus.
    """
    found = _best_of_tasks(probes, vectors, k, key, vector, most_probes, 9, label, bonus)
    score = F.round("score", 9) + F.when(F.col("_same"), bonus).otherwise(0.0)
    order = Window.partitionBy("probe").orderBy(F.desc("score"), key)
    return found.withColumn("score", score).filter(F.col("score") >= least).drop("_same").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class _Best:
    """The k best candidates of each probe so far: scores rounded down the line, ties to the least key.

    What is held is k places a probe; scores are computed a tile of CELLS at a time, so memory is that of the places however many probes and vectors meet.
    """

    def __init__(self, probes: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.floor = np.full(probes, -np.inf)
        self.held: tuple[np.ndarray, ...] | None = None  # of each probe k places: key, score, of the probe's label
        self.count = np.zeros(probes, np.int64)  # places taken

    def scan(self, keys: np.ndarray, vectors: np.ndarray, asked: np.ndarray, probes: np.ndarray | None = None, labels: tuple[np.ndarray, np.ndarray] | None = None, bonus: float = 0.0) -> None:
        """Candidates `keys` with their vectors for all probes `asked`, or for those numbered `probes`; labels: codes of the probes' and of the vectors'."""
        rows = np.arange(len(asked)) if probes is None else probes
        if not len(keys) or not len(rows):
            return
        step = max(1, CELLS // len(keys))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            self._add(keys, asked[part] @ vectors.T, part, None if labels is None else labels[0][part, None] == labels[1][None, :], bonus)

    def _add(self, keys: np.ndarray, score: np.ndarray, probes: np.ndarray, same: np.ndarray | None, bonus: float) -> None:
        shown, slack = score if same is None else score + bonus * same, 2 * 10.0**-self.digits
        good = shown >= self.floor[probes, None] - slack
        if score.shape[1] > self.k and np.count_nonzero(good) > 2 * self.k * len(probes):  # as long as little is known
            known = np.where(np.isnan(shown), -np.inf, shown)
            good &= shown >= np.partition(known, -self.k, axis=1)[:, -self.k, None] - slack
        r, c = np.nonzero(good)
        if not len(r):
            return
        if self.held is None:
            self.held = tuple(np.zeros((len(self.floor), self.k), kind) for kind in (keys.dtype, np.float64, bool))
        own, r = np.unique(r, return_inverse=True)
        at = probes[own]
        old, place = np.nonzero(np.arange(self.k) < self.count[at, None])
        new = (r, keys[c], score[own[r], c], np.zeros(len(r), bool) if same is None else same[own[r], c])
        p, key, plain, alike = (np.concatenate(x) for x in zip((old, *(h[at[old], place] for h in self.held)), new, strict=True))
        value = np.round(plain, self.digits) + bonus * alike
        order = np.lexsort((key, -value, p))
        first = np.flatnonzero(np.diff(p[order], prepend=-1))
        place = np.arange(len(p)) - np.repeat(first, np.diff(first, append=len(p)))
        kept, place = order[place < self.k], place[place < self.k]
        for held, x in zip(self.held, (key, plain, alike), strict=True):
            held[at[p[kept]], place] = x[kept]
        self.count[at] = np.minimum(np.bincount(p, minlength=len(at)), self.k)
        last = kept[place == self.k - 1]
        self.floor[at[p[last]]] = value[last]

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Probe, key, score, of the probe's label: of some probes at a time."""
        step = max(1, ROWS_OUT // max(1, self.k))
        for at in range(0, len(self.count) if self.held is not None else 0, step):
            p, place = np.nonzero(np.arange(self.k) < self.count[at : at + step, None])
            if len(p):
                yield p + at, *(h[p + at, place] for h in self.held)


def _best_of_tasks(probes: DataFrame, vectors: DataFrame, k: int, key: str, vector: str, most_probes: int, digits: int, label: str | None = None, bonus: float = 0.0) -> DataFrame:
    """probe, key, score (and, with a label, _same: of the probe's label): the k best rows that each task has for each probe."""
    spark, fields = vectors.sparkSession, [label] if label else []
    asked = checkpointed(probes.filter(F.col(vector).isNotNull()).select("probe", *fields, F.col(vector).cast("array<double>").alias(vector)))
    passes = max(1, -(-(asked.agg(F.sum(F.greatest(F.size(vector), F.lit(k)))).first()[0] or 0) // most_probes))
    rows = vectors.filter(F.col(vector).isNotNull()).select(key, *fields, F.col(vector).cast("array<double>").alias(vector))
    kinds = f"probe {probes.schema['probe'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double" + (", _same boolean" if label else "")
    out = None
    for i in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("probe"), F.lit(passes)) == i).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((part["probe"].combine_chunks(), _matrix(part[vector]) if len(part) else None, part[label].combine_chunks() if label else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, p, labels = shared.value
            if p is None:
                return
            best = _Best(len(names), k, digits)
            for batch in batches:
                for at in range(0, len(batch), VECTORS_IN_BLOCK):
                    block = batch.slice(at, VECTORS_IN_BLOCK)
                    codes = None
                    if label:
                        known = pc.unique(block.column(label)).drop_null()
                        codes = tuple(np.asarray(pc.index_in(x, known).fill_null(none)) for x, none in ((labels, -1), (block.column(label), -2)))
                    best.scan(block.column(key).to_numpy(zero_copy_only=False), _matrix(block.column(vector)), p, labels=codes, bonus=bonus)
            for at, keys, plain, alike in best.rows():
                found = [names.take(pa.array(at)), pa.array(keys, batch.schema.field(key).type), pa.array(plain)]
                yield pa.RecordBatch.from_arrays(found + ([pa.array(alike)] if label else []), ["probe", key, "score"] + (["_same"] if label else []))

        here = rows.mapInArrow(run, kinds)
        out = here if out is None else out.unionByName(here)
    return out


def ranked(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """A 1-based rank within each list."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rrf(rankings: Sequence[tuple[DataFrame, float, str]], key: str = "chunk_id", query: str | None = None, k: int = RRF_K) -> DataFrame:
    """query, key, score = sum of weight / (k + rank), and the rank in each named list; rankings hold query, key and a 1-based rank.

    Ties go to the item that appears first, lists taken in order.
    """
    by = [query, key] if query else [key]
    union = None
    for place, (df, weight, name) in enumerate(rankings):
        part = df.select(*by, "rank", F.lit(float(weight)).alias("_w"), F.lit(name).alias("_list"), F.lit(place).alias("_place"))
        union = part if union is None else union.unionByName(part)
    # terms are added in list order, so the sum does not depend on the order of rows
    terms = F.transform(F.array_sort(F.collect_list(F.struct("_place", (F.col("_w") / (k + F.col("rank"))).alias("x")))), lambda t: t["x"])
    ranks = [F.min(F.when(F.col("_list") == name, F.col("rank"))).alias(name) for _, _, name in rankings]
    first = F.min(F.struct("_place", "rank")).alias("_first")
    return union.groupBy(*by).agg(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("score"), *ranks, first)


def by_score(fused: DataFrame, query: str | None = None) -> DataFrame:
    """`position` of the fused items, best first. Without a query column the list is one answer's and short."""
    window = (Window.partitionBy(query) if query else Window).orderBy(F.desc("score"), "_first")
    return fused.withColumn("position", F.row_number().over(window)).drop("_first")


def kind_priority(kind: Column, doc_type: Column) -> Column:
    """Official act files over other files over all else."""
    return F.when((kind == "file") & F.coalesce(doc_type != "", F.lit(False)), 2).when(kind == "file", 1).otherwise(0)


def deduplicated(df: DataFrame, group: list[str], priority: Column, score: str, order: str) -> DataFrame:
    """One row of each group, that of highest priority and score (then the first by `order`), with the group's best score.

    Grouped maxima of structs: partial aggregation keeps one row a group and task.
    """
    columns = [c for c in df.columns if c not in group]
    row = F.max_by(F.struct(*columns), F.struct(priority.alias("p"), F.col(score).alias("s"), (-F.col(order)).alias("o")))
    best = df.groupBy(*group).agg(row.alias("_row"), F.max(score).alias("_score"))
    return best.select(*group, *[(F.col("_score") if c == score else F.col(f"_row.{c}")).alias(c) for c in columns])


def first_wins(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key; rows of a null key all stay."""
    keyed = df.withColumn("_key", key)
    if not order:
        raise ValueError("an order is needed")
    first = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    # rows without a key need no comparison, so they stay where they are
    once = keyed.filter("_key is not null").withColumn("_n", first).filter("_n = 1").drop("_n")
    return once.unionByName(keyed.filter("_key is null")).drop("_key")


def newest_first(df: DataFrame, date: str, order: str) -> list[Column]:
    """Sort keys: dated rows newest first, undated ones after them in their order."""
    return [F.desc_nulls_last(date), F.col(order)]


def with_newest(df: DataFrame, query: str, position: str, date: str, top: int = 12) -> DataFrame:
    """The first `top` rows of a query and the newest dated row below them if it is newer than all of those."""
    kept = F.max(F.when(F.col(position) <= top, F.col(date))).over(Window.partitionBy(query))
    below = F.when(F.col(position) > top, F.col(date))
    newest = F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_last(below), F.col(position)))
    marked = df.withColumn("_kept", kept).withColumn("_newest", newest)
    late = (F.col(position) > top) & F.col(date).isNotNull() & (F.col("_newest") == 1) & (F.col("_kept").isNull() | (F.col(date) > F.col("_kept")))
    return marked.filter((F.col(position) <= top) | late).drop("_kept", "_newest")


def interleaved(base: DataFrame, fresh: DataFrame, query: str, order: str, at: int = 6) -> DataFrame:
    """Rows of `base` with those of `fresh` put in after the first `at`; `place` is the new order."""
    both = base.withColumn("_s", F.when(F.col(order) <= at, 0).otherwise(2)).unionByName(fresh.withColumn("_s", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("_s", order))).drop("_s")


def stratified(df: DataFrame, by: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """At most n rows of each stratum, those with the least md5 of key and seed, so the sample is the same on every run and in other engines."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def within_budget(df: DataFrame, query: str, order: str, size: Column, most: int) -> DataFrame:
    """The leading rows of a query whose sizes add up to at most `most`."""
    total = F.sum(size).over(Window.partitionBy(query).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_total", total).filter(F.col("_total") <= most).drop("_total")
