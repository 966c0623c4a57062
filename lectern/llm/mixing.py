"""Mixing of sources to target weights, where a document may belong to several sources.

Documents are added up by membership pattern, the set of sources that a document belongs to. Patterns and sources are a flow network: each pass over a pattern's
words is an arc with their number as capacity, and each further pass costs more; an arc leads from a pattern to each of its sources, and a source takes
its quota. Patterns without a common source, even by way of others, are separate networks, one row a pattern, and each is solved in a task of its own. Passes cost
the same for all patterns, so shortest paths are found pass by pass: a maximum flow with the first passes open, augmented as the next ones open.

A pattern's flow becomes whole passes over its documents and a rest. The rest goes to the documents with the least seeds (md5 of a seed, key and text); the border seed
is found by sums over ranges of seeds, twelve bits at a time, so no pattern is sorted or held in one task. The border document is taken in part, so quotas are met to the word.

Defined results: null texts have no words and take part with 0; null sources are one source, the last in order; an empty member list belongs nowhere and is taken 0 times;
rows that are equal in key and text have one seed, and at the border each gets an equal share (rounded; the quota is missed by less than one word for each of them);
a key with several texts is several documents; sources without words have a target of 0; an empty table gives no rows; other columns pass through `carry` only.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lectern.llm.components import components
from lectern.llm.skew import joined_by_count
from lectern.llm.textwords import SPACED, chunks
from lectern.operators.records import numbered
from lectern.session import checkpointed

#: Weights of the sources in their order, repeating; the mix's size as a part of all words; passes over a document, at most.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
SEED = "mix"
_BITS, _ROUNDS = 12, 5  # 60 bits of md5
MAX_ROUNDS = 1000


def named(source: Column) -> Column:
    """A name that is never null and sorts as the source does, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words in place of the text, which is the last column."""
    for part, buf, offs in chunks(batches, "_text"):
        mask = SPACED[buf]
        starts = mask.copy()
        starts[1:] &= ~mask[:-1]
        first = offs[:-1][offs[:-1] < len(buf)]
        starts[first] = mask[first]
        before = np.concatenate(([0], np.cumsum(starts)))
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(before[offs]))], [*part.schema.names[:-1], "_size"])


def sized(docs: DataFrame, members: Column, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (), seed: str = SEED) -> DataFrame:
    """`carry`, _pattern, _seed, _size of each document, written; `members` is an array of named sources."""
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(body)))
    number = F.conv(F.substring(digest, 1, _BITS * _ROUNDS // 4), 16, 10).cast("long")
    rows = docs.select(*carry, F.array_sort(F.array_distinct(members)).alias("_pattern"), number.alias("_seed"), body.alias("_text"))
    return checkpointed(rows.mapInArrow(_word_counts, T.StructType([*rows.schema.fields[:-1], T.StructField("_size", T.LongType())])))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = PASSES) -> DataFrame:
    """Columns target and _rank for a written table of _source and size, one row a source.

    Shares of `share` times all sizes by weight, none above `most` times its source's size; the excess is shared again by weight until none is above.
    Each round is one sum over the sources.
    """
    ranked = numbered(sources, ["_source"], "_rank")
    ranked = checkpointed(ranked.withColumn("_weight", F.get(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int"))).withColumn("_most", F.col("size") * most))
    total = share * (ranked.agg(F.sum("size")).first()[0] or 0)
    level, held = 0.0, -1
    for _ in range(MAX_ROUNDS):
        over = F.col("_most") < F.col("_weight") * F.lit(level)
        found = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("_most"))).alias("full"), F.sum(F.when(~over, F.col("_weight"))).alias("weight")).first()
        if found["n"] == held:
            break
        held = found["n"]
        if not found["weight"]:
            break
        level = (total - (found["full"] or 0)) / found["weight"]
    else:
        raise RuntimeError(f"targets did not settle in {MAX_ROUNDS} rounds")
    return ranked.withColumn("target", F.least(F.col("_most").cast("double"), F.col("_weight") * F.lit(level)))


def min_cost_flow(words: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], passes: int) -> dict[tuple[int, int], int]:
    """Words from pattern i to source j: as much of all quotas as can be met, with the least sum of pass numbers over all words.

    A path of least cost is one from a pattern whose pass is open, by way of sources and of patterns that gave to them, to a source with quota left.
    """
    flow: dict[tuple[int, int], int] = collections.defaultdict(int)
    givers: list[set[int]] = [set() for _ in quotas]
    left = list(quotas)
    for _ in range(passes):
        free = list(words)
        while path := _shortest(free, members, left, givers):
            amount = min(free[path[0]], left[path[-1]], *(flow[path[k + 1], path[k]] for k in range(1, len(path) - 2, 2)))
            for k in range(0, len(path) - 1, 2):  # pattern, source, pattern, source ...
                flow[path[k], path[k + 1]] += amount
                givers[path[k + 1]].add(path[k])
                if k:
                    flow[path[k], path[k - 1]] -= amount
                    if not flow[path[k], path[k - 1]]:
                        givers[path[k - 1]].discard(path[k])
            free[path[0]] -= amount
            left[path[-1]] -= amount
    return {k: n for k, n in flow.items() if n}


def _shortest(free: Sequence[int], members: Sequence[Sequence[int]], left: Sequence[int], givers: Sequence[set[int]]) -> list[int] | None:
    """Pattern, source, pattern, source, ... of a path with the fewest arcs."""
    before: dict[int, int | None] = {i: None for i, n in enumerate(free) if n}
    reached: dict[int, int] = {}
    queue = collections.deque(before)
    while queue:
        i = queue.popleft()
        for j in members[i]:
            if j in reached:
                continue
            reached[j] = i
            if left[j]:
                path = [j, i]
                while (j := before[i]) is not None:
                    i = reached[j]
                    path += [j, i]
                return path[::-1]
            for other in sorted(givers[j]):
                if other not in before:
                    before[other] = j
                    queue.append(other)
    return None


def _networks(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`patterns` with the _network each belongs to, and the networks of sources that share patterns with others."""
    linked = patterns.filter(F.size("_pattern") > 1).select(F.col("_pattern")[0].alias("a"), F.explode("_pattern").alias("b"))
    roots = components(linked, "a", "b")
    own = patterns.withColumn("node", F.col("_pattern")[0]).join(roots, "node", "left")
    return own.withColumn("_network", F.coalesce("root", "node")).drop("node", "root"), roots


def flows(docs: DataFrame, quotas: DataFrame, passes: int = PASSES) -> DataFrame:
    """_pattern, n documents, words and _flow, the words that the mix takes of the pattern, for a `sized` table and quotas _source, target."""
    patterns = checkpointed(docs.groupBy("_pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("words")))
    own, roots = _networks(patterns.filter(F.size("_pattern") > 0))
    wanted = quotas.select(F.col("_source").alias("node"), F.round("target").cast("long").alias("quota")).join(roots, "node", "left").withColumn("_network", F.coalesce("root", "node"))

    def solved(_: tuple, mine: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        mine = mine.assign(said=[tuple(p) for p in mine["_pattern"]]).sort_values("said", ignore_index=True)
        sources = sources.sort_values("node")
        place = {name: j for j, name in enumerate(sources["node"])}
        members = [[place[s] for s in p if s in place] for p in mine["said"]]
        taken = collections.Counter()
        for (i, _j), n in min_cost_flow(mine["words"].tolist(), members, sources["quota"].tolist(), passes).items():
            taken[i] += n
        return mine[["_pattern"]].assign(_flow=[taken[i] for i in range(len(mine))])

    found = own.groupBy("_network").cogroup(wanted.groupBy("_network")).applyInPandas(solved, "_pattern array<string>, _flow long")
    return checkpointed(patterns.join(found, "_pattern", "left").na.fill(0, ["_flow"]))


def selected(docs: DataFrame, flow: DataFrame) -> DataFrame:
    """A `sized` table with the number of words `taken` of each document."""
    whole = F.when(F.col("words") > 0, F.expr("_flow div words")).otherwise(F.lit(0))
    border = checkpointed(flow.select("_pattern", "n", whole.alias("_passes"), F.when(F.col("words") > 0, F.col("_flow") % F.col("words")).otherwise(F.lit(0)).alias("_rest"), F.lit(0).cast("long").alias("_at")))
    rows, last = docs.filter("_size > 0"), 2**_BITS - 1
    for k in range(_ROUNDS):
        part = F.expr(f"shiftright(_seed, {_BITS * (_ROUNDS - 1 - k)}) & {last}")
        ranges = rows.groupBy("_pattern", part.alias("_part")).agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_rows"))
        # 2 ** _BITS rows of a pattern, at most
        ordered = Window.partitionBy("_pattern").orderBy("_part")
        sums = ranges.withColumn("_to", F.sum("_words").over(ordered)).join(border.drop("n", "_words"), "_pattern").filter("_to > _rest AND _to - _words <= _rest")
        border = checkpointed(sums.select("_pattern", F.col("_rows").alias("n"), "_passes", (F.col("_rest") - F.col("_to") + F.col("_words")).alias("_rest"), F.expr(f"_at * {2**_BITS} + _part").alias("_at"), "_words"))
        if k < _ROUNDS - 1:  # of the rows only those in the border's range
            near = joined_by_count(rows.select("_pattern", "_seed", "_size"), border.select("_pattern", "n", "_at"), "_pattern", "n")
            rows = checkpointed(near.filter(F.expr(f"shiftright(_seed, {_BITS * (_ROUNDS - 1 - k)}) = _at")).drop("n", "_at"))
    ends = flow.select("_pattern", "n").join(border.drop("n"), "_pattern", "left").na.fill(0, ["_passes", "_rest"]).na.fill(-1, ["_at"]).na.fill(1, ["_words"])
    share = F.when(F.col("_seed") < F.col("_at"), F.col("_size")).when(F.col("_seed") == F.col("_at"), F.expr("(2 * _rest * _size + _words) div (2 * _words)")).otherwise(F.lit(0))
    out = joined_by_count(docs, checkpointed(ends), "_pattern", "n").withColumn("taken", (F.col("_passes") * F.col("_size") + share).cast("long"))
    return out.drop("n", "_passes", "_rest", "_at", "_words")


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", members: Column | None = None, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = SEED) -> DataFrame:
    """key, size, source_size, target and taken of each document; by `members` (an array of `named` sources) it may belong to more sources than its own.

    Sizes and targets are those of the document's own source.
    """
    rows = sized(docs.select(F.col(key), F.col(text), F.col(source), named(F.col(source)).alias("_source"), (F.array("_source") if members is None else members).alias("_members")), F.col("_members"), key, text, [key, "_source"], seed)
    sources = checkpointed(rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("docs")))
    quotas = checkpointed(targets(sources, weights, share, passes).select("_source", F.col("size").alias("source_size"), "target", "docs"))
    out = joined_by_count(selected(rows, flows(rows, quotas, passes)), quotas, "_source", "docs")
    return out.select(key, F.col("_size").alias("size"), "source_size", "target", "taken")
