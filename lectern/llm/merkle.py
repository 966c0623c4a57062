"""A Merkle manifest of a table: a hash tree for each group, one tree over the groups, and a version of the tree for each changed leaf.

Leaves are numbered in each group by key and cut into aligned blocks of RUN ** LEVELS. A task builds the subtree of one block; the roots of the
blocks are the leaves of the next round, until one node of each group remains, and the groups' nodes are the leaves of one more tree. Every node
keeps the digests to its left and right in its run, so what a block needs from above is one short row.

The tree is persistent: a changed leaf makes a version that copies only its ancestors and shares every other node. Copies begin inside the leaf's block and
go on through the rows from above, up to a root of the version's own; no node of the first tree is ever written again.

Defined results: a null field is `-` in its leaf, so null and empty differ; null groups come first, null keys come first in their group and are never changed by
`lower_every_third`; repeated keys stand in the order of their leaves, and equal rows are equal leaves with a place each; a null text has nothing to change;
a group of one row has its leaf as root; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import checkpointed, shared_dir

RUN = 8
#: Levels of a block of leaves that one task builds.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Equal rows are dealt over as many ranges, at most.
SALTS = 1024

#: So many groups, a short row each, are broadcast to their blocks; more meet them in a shuffled join.
MAX_BROADCAST_GROUPS = 20_000

_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class BlockTree:
    """The nodes of one aligned block, level by level; a block that holds all leaves of its group ends at its first lone node."""

    def __init__(self, leaves: Sequence[str], lone: bool, levels: int = LEVELS):
        self.levels = [list(leaves)]
        while len(self.levels) <= levels and not (lone and len(self.levels[-1]) == 1):
            now = self.levels[-1]
            self.levels.append([digest(*now[i : i + RUN]) for i in range(0, len(now), RUN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def sides(self, i: int) -> Iterator[tuple[str, str]]:
        """Of leaf i and its ancestors below the root, the digests to the left and to the right in the run."""
        for nodes in self.levels[:-1]:
            first = i - i % RUN
            yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + RUN])
            i //= RUN


def copied(leaf: str, sides: Sequence[tuple[str, str]]) -> list[str]:
    """The ancestors that a version with this leaf copies, the root last; all their other children are shared."""
    out = []
    for left, right in sides:
        leaf = digest(left, leaf, right)
        out.append(leaf)
    return out


@dataclass(frozen=True)
class Manifest:
    """leaves: _g, _pos, _key, leaf, changed; blocks: _g, _block, subroot, root and the path from the block's root up to the root."""

    leaves: DataFrame
    blocks: DataFrame
    key_type: str
    levels: int


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of fields with their lengths in bytes, `-` for nulls."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def lower_every_third(key: str, text: str) -> dict[str, Column]:
    """What an intruder does to the rows whose crc32 of the key 3 divides: A-Z of the text become a-z."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return {text: F.when(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, low).otherwise(F.col(text))}


def _placed(rows: DataFrame, group: str, order: list[str], levels: int) -> DataFrame:
    """`rows`, a written table, with _pos from 0 in each group and _block. They are dealt by ranges; across ranges only counts are summed."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    salted = rows.withColumn("_salt", F.monotonically_increasing_id() % SALTS)
    salted.repartitionByRange(group, *order, "_salt").withColumn("_range", F.spark_partition_id()).drop("_salt").write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    out = dealt.withColumn("_in", inside).join(before, [group, "_range"]).withColumn("_pos", (F.col("_before") + F.col("_in")).cast("long"))
    return out.withColumn("_block", F.expr(f"_pos div {RUN**levels}")).drop("_range", "_in", "_before")


def _tree(block: int, rows: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, BlockTree]:
    rows = rows.sort_values("_pos")
    return rows, BlockTree(rows["leaf"], lone=block == 0 and len(rows) < RUN**levels, levels=levels)


def _block_roots(leaves: DataFrame, levels: int) -> DataFrame:
    def root(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_g": [key[0]], "_pos": [key[1]], "leaf": [_tree(key[1], rows, levels)[1].root]})

    return leaves.select("_g", "_block", "_pos", "leaf").groupBy("_g", "_block").applyInPandas(root, "_g string, _pos long, leaf string")


def _climbed(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """From nodes _g, _pos, leaf: their paths to the top of their group as _g, _pos, _path, and the tops as _g, leaf. A round divides the rows by RUN ** levels."""

    def paths(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, tree = _tree(key[1], rows, levels)
        own = [[{"left": a, "right": b} for a, b in tree.sides(i)] for i in range(len(rows))]
        return rows[["_g", "_pos"]].assign(_up=key[1], _path=own, _root=tree.root)

    nodes, rounds = checkpointed(nodes), []
    while not rounds or (nodes.agg(F.max("_pos")).first()[0] or 0) > 0:
        blocks = nodes.withColumn("_block", F.expr(f"_pos div {RUN**levels}")).groupBy("_g", "_block")
        rounds.append(checkpointed(blocks.applyInPandas(paths, f"_g string, _pos long, _up long, _path {_PATH}, _root string")))
        nodes = rounds[-1].groupBy("_g", F.col("_up").alias("_pos")).agg(F.first("_root").alias("leaf"))
    found = None
    for part in reversed(rounds):
        part = part.select("_g", "_pos", "_up", "_path")
        if found is not None:
            above = found.select("_g", F.col("_pos").alias("_up"), F.col("_path").alias("_above"))
            part = part.join(above, ["_g", "_up"]).withColumn("_path", F.concat("_path", "_above"))
        found = part.select("_g", "_pos", "_path")
    return found, nodes.select("_g", "leaf")


def build(df: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, changes: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of a table, with the leaf of each row and the leaf it has after `changes` to some of its fields."""
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then bytewise
    after = [(changes or {}).get(f, F.col(f)) for f in fields]
    rows = checkpointed(df.select(g.alias("_g"), F.col(key).alias("_key"), leaf([F.col(f) for f in fields]).alias("leaf"), leaf(after).alias("changed")))
    leaves = checkpointed(_placed(rows, "_g", ["_key", "leaf"], levels))
    paths, tops = _climbed(_block_roots(leaves, levels), levels)
    tops = checkpointed(tops.withColumnRenamed("_g", "_of").withColumn("_g", F.lit("")))
    places = checkpointed(_placed(tops, "_g", ["_of"], levels))
    above, top = _climbed(places.select("_g", "_pos", "leaf"), levels)
    root = top.first()  # one row, or none of an empty table
    groups = places.join(above.select("_pos", F.col("_path").alias("_above")), "_pos")
    groups = groups.select(F.col("_of").alias("_g"), F.col("leaf").alias("subroot"), F.lit(root and root["leaf"]).cast("string").alias("root"), "_above")
    if places.count() <= MAX_BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    blocks = paths.join(groups, "_g").select("_g", F.col("_pos").alias("_block"), "subroot", "root", F.concat("_path", "_above").alias("_path"))
    return Manifest(leaves, checkpointed(blocks), df.schema[key].dataType.simpleString(), levels)


def audit(m: Manifest, key: str = "doc_id") -> DataFrame:
    """key, leaf, changed, subroot, root, proof_sha256, copies, folded_root, verified: one row for each row of the table.

    copies holds the ancestors that the version of the changed leaf has of its own, the root last; it is empty for a table of one row.
    """
    levels = m.levels

    def versions(group: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, tree = _tree(group[1], rows, levels)
        up = above.iloc[0]
        higher = [(x["left"], x["right"]) for x in up["_path"]]
        shared = "".join(a + b for a, b in higher).encode()
        proofs, copies = [], []
        for i, now in enumerate(rows["changed"]):
            sides = list(tree.sides(i))
            proof = sha256("".join(a + b for a, b in sides).encode())
            proof.update(shared)
            proofs.append(proof.hexdigest())
            copies.append(copied(now, sides + higher))
        folded = [c[-1] if c else now for c, now in zip(copies, rows["changed"], strict=True)]
        out = rows[["_key", "leaf", "changed"]].assign(subroot=up["subroot"], root=up["root"], proof_sha256=proofs, copies=copies, folded_root=folded)
        return out.assign(verified=out["folded_root"] == out["root"])

    schema = "_key string, leaf string, changed string, subroot string, root string, proof_sha256 string, copies array<string>, folded_root string, verified boolean"
    # keys travel as text, as a whole number beside a null would become a float
    leaves = m.leaves.select("_g", "_block", "_pos", F.col("_key").cast("string").alias("_key"), "leaf", "changed")
    found = leaves.groupBy("_g", "_block").cogroup(m.blocks.groupBy("_g", "_block")).applyInPandas(versions, schema)
    return found.select(F.col("_key").cast(m.key_type).alias(key), *found.columns[1:])
