"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no component is ever held in one task, and the number of steps grows with
the logarithm of the longest path. Nodes with very many edges are joined by broadcast (fewer than a stated number can have more than its
part of all edges), so no hub is one task's work. Each step is materialised in the shared folder, so a lost executor costs little.
A table of at most FEW_EDGES edges, which would be dealt to many nearly empty tasks in every step, is settled in one pass of one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed

MAX_STEPS = 60
HUBS = 1000
FEW_EDGES = 100_000


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One step over n edges, which hold u > v."""

    def met(left: DataFrame, least: DataFrame) -> DataFrame:
        # hubs, fewer than HUBS, by broadcast; the others by an exchange
        hub = F.col("n") * HUBS > 2 * n
        hubs = F.broadcast(least.filter(hub))
        met = left.join(hubs, "u").unionByName(left.join(hubs.select("u"), "u", "left_anti").join(least.filter(~hub), "u"))
        return met.select(F.col("v").alias("u"), F.col("m").alias("v"))

    if large:  # every neighbour above u goes to the least of u and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        out = met(both.filter(F.col("v") > F.col("u")), least)
    else:  # u and its neighbours below go to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        out = met(edges, least).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: every node above the least of its component, and that one."""
    above: dict = {}
    kind = None

    def root(x):
        top = x
        while above.get(top, top) != top:
            top = above[top]
        while x != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            u, v = root(u), root(v)
            above[max(u, v)] = min(u, v)
    found = [(u, v) for u in list(above) if (v := root(u)) != u]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame, a: str, b: str, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node with an edge, root the least node of its component; roots have a row of their own."""
    now = checkpointed(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    if now.count() <= few:
        kind = now.schema["u"].dataType.simpleString()
        return _rooted(checkpointed(now.coalesce(1).mapInArrow(_settled, f"u {kind}, v {kind}")))
    state = None
    for _ in range(MAX_STEPS):
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found[0] == 0 or (found[0], found[1]) == state:
            break
        state = (found[0], found[1])
        stars = checkpointed(_star(now, True, found[0]))
        now = checkpointed(_star(stars, False, stars.count()))
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    return _rooted(now)


def _rooted(now: DataFrame) -> DataFrame:
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
