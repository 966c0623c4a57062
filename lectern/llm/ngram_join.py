"""N-gram Jaccard join by signature trees: all documents linked by shingle sets at or above a similarity.

1. Every text becomes a set of 64-bit shingle hashes, its size, two sums that name it and a parity bitmap. Equal sets fall
   together at once: one representative each goes on.
2. Exact candidates. Sets with Jaccard p/100 differ in at most d = (100-p)(|A|+|B|)/(100+p) shingles. Cut by
   hash into more than d parts, a set with more than d parts that are not empty agrees with the other in one of these, so they share its key.
   Parts are enough for nearly all sets to be so; those that are not also give their least shingles as keys, as many as two linked
   sets can't differ in, so two such sets share one of these. No key is that of an empty part. Sets that share a key may be linked
   only if their parity bitmaps differ in at most d bits; sets so joined, directly or by others, form a block. A group
   that shares a key is compared with regard to components found so far; one of more than TILE_SETS is a block as it is.
3. Blocks over a bound are cut into tiles.
4. In each tile a signature tree (nodes: OR and AND of their members' token bitmaps, range of set sizes) is walked against
   itself; pairs of nodes whose greatest possible overlap is too small, or that are wholly in one component
   already, are dropped; pairs of members that remain are compared exactly.
5. Blocks of several tiles first link within tiles, then between tile leaders, and then between the tiles that
   still hold different components. No pair is given up, and a dense group settles after the first two.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing; texts of fewer than
k words are one shingle; repeated rows share an id and a component; an id on different texts links by each of them, and each has the component of its own text; ties go to the smallest id; ids must be integers; a row with a null id
links nothing, and its component is that of an equal set, else null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.clashes import fresh
from lectern.llm.components import components
from lectern.llm.skew import MOST_HOT
from lectern.llm.textwords import SPACED, Words, chunks, mixed, signed, words_of
from lectern.session import checkpointed, shared_dir

#: Parts beyond those that linked sets can differ in, besides those that are likely to be empty.
SPARE = 2
#: Size classes for the number of parts; the ratio of neighbouring bounds must exceed 100 / percent.
CLASS_RATIO = 1.5
#: Bounds of a tile, in shingles and in sets.
TILE_SHINGLES, TILE_SETS = 3_000_000, 4096
LEAF, FANOUT = 16, 8
ID_BUCKETS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Sets A and B are linked when 100 * |A and B| >= percent * |A or B|."""

    k: int = 5
    percent: int = 80

    def class_bounds(self, top: int) -> list[int]:
        bounds = [1]
        while bounds[-1] <= top:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_RATIO)))
            if 100 * (bounds[-2]) >= self.percent * bounds[-1] and bounds[-2] > 100:
                raise ValueError("size classes are too narrow")
        return bounds

    def parts(self, bound: int) -> int:
        """Parts for sets smaller than `bound`."""
        most = self.differing(bound - 1, bound - 1)
        empty = most * math.exp(-(100 + self.percent) / (2 * (100 - self.percent))) if self.percent < 100 else 0.0
        return most + 1 + SPARE + math.ceil(empty + 4 * math.sqrt(empty))

    def differing(self, n: int, other: int) -> int:
        """The most shingles in which linked sets of these sizes differ."""
        return (100 - self.percent) * (n + other) // (100 + self.percent)

    def needed(self, sizes: np.ndarray | int) -> np.ndarray | int:
        """The least overlap of linked sets, from the sum of their sizes (rounded up)."""
        return -(-self.percent * sizes // (100 + self.percent))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    grams = {n: words.grams(n) for n in range(1, k + 1)}
    first, counts = words.first.tolist(), words.counts.tolist()
    none = np.zeros(0, np.uint64)
    out = []
    for at, n in zip(first[:-1], counts, strict=True):
        m = min(n, k)
        out.append(np.unique(grams[m][at : at + n - m + 1]) if n else none)
    return out


def part_keys(s: np.ndarray, rule: Rule, bounds: list[int]) -> np.ndarray:
    """The blocking keys of a set of size class c, and of class c + 1 where larger partners can be there."""
    n = len(s)
    c = int(np.searchsorted(bounds, n, "right")) - 1
    keys, few = [], False
    m1 = mixed(s + np.uint64(0x51ED2701))
    for at in (c, c + 1):
        if at > c and 100 * n < rule.percent * bounds[at]:
            break
        m = rule.parts(bounds[at + 1])
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part = part[order].astype(np.int64)
        begins = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        salt = np.uint64(at * 1_000_003)
        named = mixed(part[begins].astype(np.uint64) + (salt << np.uint64(24)))
        keys.append(mixed(np.add.reduceat(m1[order], begins) + named))
        few |= len(begins) <= rule.differing(n, min(100 * n // rule.percent, bounds[at + 1] - 1))
    if few:
        keys.append(mixed(s[: n + rule.percent * n // -100 + 1] + np.uint64(1 << 60)))
    return np.concatenate(keys)


def parity(s: np.ndarray) -> np.ndarray:
    """Each bit tells whether an odd number of shingles fall on it; about a bit a shingle, 128 to 8192."""
    bits = 128
    while bits < len(s) and bits < 8192:
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap at a smaller width; the difference of two folded ones is still at most that of their sets."""
    while len(bitmap) > words:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums of hashes of each set."""
    total = np.concatenate([np.zeros(0, np.uint64), *sets])
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(total + np.uint64(x)), dtype=np.uint64))) for x in (7, 13)]
    return np.diff(at), *(signed(c[at[1:]] - c[at[:-1]]) for c in sums)


def _profiles(docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """_id, _n, _s1, _s2 (which name the set), _sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text):
            sets = shingle_sets(words_of(buf, offs, SPACED), rule.k)
            n, s1, s2 = set_names(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(key)).cast(pa.int64()), pa.array(n), pa.array(s1), pa.array(s2), pa.array([parity(s).tobytes() for s in sets], pa.binary())],
                ["_id", "_n", "_s1", "_s2", "_sig"],
            )

    return docs.select(key, text).mapInArrow(run, "_id long, _n long, _s1 long, _s2 long, _sig binary")


def _keys(docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """_rep, _key: one row for each blocking key of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = rule.class_bounds(1 << 20)
        for part, buf, offs in chunks(batches, text):
            sets = shingle_sets(words_of(buf, offs, SPACED), rule.k)
            top = max(map(len, sets), default=0)
            if top >= bounds[-3]:
                bounds = rule.class_bounds(4 * top)
            keys = [part_keys(s, rule, bounds) if len(s) else np.zeros(0, np.uint64) for s in sets]
            ids = part.column(part.schema.get_field_index(key)).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *keys])))], ["_rep", "_key"])

    return docs.select(key, text).mapInArrow(run, "_rep long, _key long")


def _group_links(reps: np.ndarray, sizes: np.ndarray, sigs: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Pairs that join the components of "may be linked" in one group, by sizes and parity bitmaps."""
    words = min(map(len, sigs))
    bits = np.stack([folded(x, words) for x in sigs])
    root = np.arange(len(reps))
    out: list[tuple[int, int]] = []
    step = max(1, (1 << 20) // (len(reps) * words))
    for a in range(0, len(reps), step):
        if root.min() == root.max():
            break
        differ = np.bitwise_count(bits[a : a + step, None] ^ bits[None]).sum(2, dtype=np.int64)
        total = sizes[a : a + step, None] + sizes[None]
        may = differ * (100 + rule.percent) <= (100 - rule.percent) * total
        for i, row in enumerate(may, a):
            while len(js := np.flatnonzero(row & (root != root[i]))):
                out.append((int(reps[i]), int(reps[js[0]])))
                root[root == root[js[0]]] = root[i]
    return out


def _may_link(shared: DataFrame, rule: Rule) -> DataFrame:
    """_a, _b: edges whose components are the blocks. `shared`: _key, _rep, _n, _sig; no key has many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []

        def close() -> list[tuple[int, int]]:
            if len(members) < 2:
                return []
            return _group_links(np.array([m[0] for m in members]), np.array([m[1] for m in members]), [np.frombuffer(m[2], np.uint64) for m in members], rule)

        for batch in batches:
            out: list[tuple[int, int]] = []
            for k, rep, n, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    out += close()
                    now, members = k, []
                members.append((rep, n, sig))
            yield _edges(out)
        yield _edges(close())

    def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["_a", "_b"])

    rows = shared.select("_key", "_rep", "_n", "_sig").repartition("_key").sortWithinPartitions("_key", "_rep")
    return rows.mapInArrow(run, "_a long, _b long")


def _sets(docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """_id, _set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text):
            sets = shingle_sets(words_of(buf, offs, SPACED), rule.k)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *sets]))))], ["_id", "_set"])

    return docs.select(key, text).mapInArrow(run, "_id long, _set array<long>")


class SignatureTree:
    """Sets in leaves of LEAF neighbours; a node holds the OR and AND of its sets' bitmaps and the range of their sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bits = 256
        while bits < 2 * self.sizes.max() and bits < 8192:
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            b = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[i], b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
        self.maps = maps
        #: levels[0] are the leaves; a node of level l covers LEAF * FANOUT ** l sets.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        step = LEAF
        while True:
            at = np.arange(0, len(sets), step)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.bitwise_and.reduceat(maps, at), np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at)))
            if len(at) == 1:
                break
            step *= FANOUT

    def span(self, level: int, node: int) -> tuple[int, int]:
        w = LEAF * FANOUT**level
        return node * w, min((node + 1) * w, len(self.sizes))

    def may_link(self, level: int, x: int, y: int, rule: Rule) -> bool:
        """Whether the greatest possible overlap of a set below x and one below y can be enough.

        Tokens that all sets of x have and no set of y has lie outside every overlap.
        """
        some, every, least, most = self.levels[level]
        if 100 * most[x] < rule.percent * least[y] or 100 * most[y] < rule.percent * least[x]:
            return False
        out_x = int(np.bitwise_count(every[x] & ~some[y]).sum())
        out_y = int(np.bitwise_count(every[y] & ~some[x]).sum())
        overlap = min(int(most[x]) - out_x, int(most[y]) - out_y)
        return overlap >= rule.needed(int(least[x] + least[y]))


def walk(ids: np.ndarray, sets: list[np.ndarray], comps: np.ndarray, sides: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that join different components among the sets, by dual traversal of their tree with itself.

    `comps`: components known before. `sides`: 0 or 1; pairs of one side are known already unless all sides are equal.
    """
    order = np.lexsort((ids, [len(s) for s in sets], [int(s[0]) for s in sets]))  # near copies mostly share the least shingle
    ids, sets, sides = ids[order], [sets[i] for i in order], sides[order]
    _, root = np.unique(comps[order], return_inverse=True)
    one_side = sides.min() == sides.max()
    tree = SignatureTree(sets)
    links: list[tuple[int, int]] = []
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        (a, b), (c, d) = tree.span(level, x), tree.span(level, y)
        lo, hi = min(root[a:b].min(), root[c:d].min()), max(root[a:b].max(), root[c:d].max())
        if lo == hi or (x != y and not tree.may_link(level, x, y, rule)):
            continue
        if level:
            below = lambda n: range(n * FANOUT, min((n + 1) * FANOUT, len(tree.levels[level - 1][2])))  # noqa: E731,B023
            pairs = [(level - 1, i, j) for i in below(x) for j in below(y) if x != y or i <= j]
            stack += sorted(pairs, key=lambda p: p[1] - p[2])  # nearest last, so they are taken first
            continue
        # two leaves: the greatest overlap of each pair, then exact counts
        ma, mc, na, nc = tree.maps[a:b], tree.maps[c:d], tree.sizes[a:b, None], tree.sizes[None, c:d]
        out_a = np.bitwise_count(ma[:, None] & ~mc[None]).sum(2, dtype=np.int64)
        out_c = np.bitwise_count(mc[None] & ~ma[:, None]).sum(2, dtype=np.int64)
        able = np.minimum(na - out_a, nc - out_c) >= rule.needed(na + nc)
        able &= root[a:b, None] != root[None, c:d]
        if not one_side:
            able &= sides[a:b, None] != sides[None, c:d]
        for i, j in zip(*(v.tolist() for v in np.nonzero(able)), strict=True):
            i, j = a + i, c + j
            if i == j or root[i] == root[j]:
                continue
            s, t = sets[i], sets[j]
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            both = int((t[at] == s).sum())
            if 100 * both >= rule.percent * (len(s) + len(t) - both):
                links.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return links


def _linked(tiles: DataFrame, by: list[str], rule: Rule) -> DataFrame:
    """Links (_a, _b) found in each tile. `tiles`: by, _id, _set, _comp, _side."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in rows["_set"]]
        links = walk(rows["_id"].to_numpy(), sets, rows["_comp"].to_numpy(), rows["_side"].to_numpy(), rule)
        return pd.DataFrame(links, columns=["_a", "_b"], dtype="int64")

    return tiles.groupBy(*by).applyInPandas(run, "_a long, _b long")


class _Store:
    """Tables written to the shared folder and read again, which cuts their lineage."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.base = f"{shared_dir(self.spark)}/ngram-join-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.parquet(f"{self.base}/{name}")


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """`members` with _comp replaced by the root of its component over `links` of _comp values."""
    roots = components(links, "_a", "_b").select(F.col("node").alias("_comp"), F.col("root").alias("_root"))
    return members.join(roots, "_comp", "left").withColumn("_comp", F.coalesce("_root", "_comp")).drop("_root")


def _comp_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links of ids turned into links of their components."""
    of = members.select("_id", "_comp")
    return links.join(of.withColumnsRenamed({"_id": "_a", "_comp": "_x"}), "_a").join(of.withColumnsRenamed({"_id": "_b", "_comp": "_y"}), "_b").select(F.col("_x").alias("_a"), F.col("_y").alias("_b"))


def _parted(docs: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` in two parts: rows that surely have none of the `ids` (column _id), and the rest.

    Ids fall in ID_BUCKETS buckets, and the table of buckets with an id is broadcast; where more than half of all would be in it, it would keep out
    little, and the rest is all of `docs`.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(ID_BUCKETS))
    taken = checkpointed(ids.select(bucket(F.col("_id")).alias("b")).distinct())
    if 2 * taken.count() > ID_BUCKETS:
        return docs.limit(0), docs
    taken = F.broadcast(taken)
    name = fresh("_bucket", docs.columns)
    marked, same = docs.withColumn(name, bucket(F.col(key))), F.col(name) == F.col("b")
    return marked.join(taken, same, "left_anti").select(*docs.columns), marked.join(taken, same, "left_semi").select(*docs.columns)


def link_groups(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text", tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS, with_name: bool = False) -> DataFrame:
    """key, n_shingles, component_id: one row for each row of `docs`; if wanted also _n, _s1, _s2, which name its set."""
    store = _Store(docs)
    kind = docs.schema[key].dataType
    profiles = store.put("profiles", _profiles(docs, rule, key, text))
    name = ["_n", "_s1", "_s2"]
    several = profiles.filter("_n > 0 and _id is not null").groupBy("_id").agg((F.min(F.struct(*name)) != F.max(F.struct(*name))).alias("_several")).filter("_several").select("_id")
    several = checkpointed(several)
    if not several.isEmpty():
        return _each_text(docs, several, rule, key, text, tile_shingles, tile_sets, with_name)
    reps = profiles.filter("_n > 0 and _id is not null").groupBy(*name).agg(F.min("_id").alias("_rep"), F.first("_sig").alias("_sig"), F.count(F.lit(1)).alias("_copies"))
    reps = store.put("reps", reps)
    # keys of representatives; a bounded table of buckets of other copies keeps most texts out of a join
    many_copies = reps.filter("_copies > 1")
    others = profiles.select("_id", *name).join(many_copies.select(*name, "_rep"), name).filter("_id <> _rep")
    sure, some = _parted(docs.filter(F.col(key).isNotNull()).select(key, text), key, others.select("_id"))
    some = some.join(reps.select(F.col("_rep").cast(kind).alias(key)), key, "left_semi").select(key, text)
    keyed = _keys(sure.unionByName(some), rule, key, text)

    # keys that more than one has: one exchange of two numbers a key, then groups are counted in sorted order (a large group spills, it is not collected)
    alike = Window.partitionBy("_key")
    shared = keyed.withColumn("_lo", F.min("_rep").over(alike)).withColumn("_many", F.count(F.lit(1)).over(alike)).filter("_many > 1")
    shared = store.put("shared", shared)
    # a group too large to compare is one block, cut into tiles later; no bitmaps are sent for it
    large = shared.filter((F.col("_many") > tile_sets) & (F.col("_lo") < F.col("_rep"))).select(F.col("_lo").alias("_a"), F.col("_rep").alias("_b"))
    small = shared.filter(F.col("_many") <= tile_sets).select("_key", "_rep").join(reps.select("_rep", "_n", "_sig"), "_rep")
    edges = store.put("edges", _may_link(small, rule).unionByName(large).distinct())
    blocks = components(edges, "_a", "_b").select(F.col("node").alias("_id"), F.col("root").alias("_block"))
    blocks = store.put("blocks", blocks.join(reps.select(F.col("_rep").alias("_id"), "_n"), "_id"))
    cuts = blocks.groupBy("_block").agg(F.greatest(F.ceil(F.sum("_n") / tile_shingles), F.ceil(F.count(F.lit(1)) / tile_sets)).cast("int").alias("_tiles"))

    # the sets of blocked representatives; a bounded table of id buckets keeps most other texts out of the join
    _, some = _parted(docs.select(key, text), key, blocks.select("_id"))
    sets = _sets(some, rule, key, text).join(blocks, "_id").dropDuplicates(["_id"]).join(cuts, "_block")
    members = store.put("members", sets.withColumn("_tile", F.pmod(F.xxhash64("_id"), F.col("_tiles")).cast("int")).withColumn("_comp", F.col("_id")).withColumn("_side", F.lit(0)))

    # within tiles
    links = store.put("links", _linked(members, ["_block", "_tile"], rule))
    many = members.filter("_tiles > 1")
    if not many.isEmpty():
        # between the leaders of components of large blocks, then between tiles that still differ
        many = store.put("many", _relabelled(many, links))
        lead = many.join(many.groupBy("_block", "_tile", "_comp").agg(F.min("_id").alias("_id")).drop("_comp"), ["_block", "_tile", "_id"])
        # leaders too are cut into bounded tiles
        led = lead.groupBy("_block").agg(F.greatest(F.ceil(F.sum("_n") / tile_shingles), F.ceil(F.count(F.lit(1)) / tile_sets)).cast("int").alias("_leads"))
        lead = lead.join(led, "_block").withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_leads")))
        more = store.put("leaders", _linked(lead, ["_block", "_part"], rule))
        many = store.put("many2", _relabelled(many, _comp_links(more, many)))
        # a tile meets another unless both are wholly in one and the same component
        nodes = many.groupBy("_block", "_tile").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi"), F.min("_n").alias("_least"), F.max("_n").alias("_most"))
        other = nodes.select("_block", *(F.col(c).alias(c + "2") for c in ("_tile", "_lo", "_hi", "_least", "_most")))
        differ = ~((F.col("_lo") == F.col("_hi")) & (F.col("_lo2") == F.col("_hi2")) & (F.col("_lo") == F.col("_lo2")))
        sizes = (100 * F.col("_most") >= rule.percent * F.col("_least2")) & (100 * F.col("_most2") >= rule.percent * F.col("_least"))
        pairs = nodes.join(other, "_block").filter((F.col("_tile") < F.col("_tile2")) & differ & sizes).select("_block", "_tile", "_tile2")
        sides = pairs.select("_block", F.col("_tile").alias("_x"), F.col("_tile2").alias("_y"), F.explode(F.array(F.struct(F.col("_tile").alias("t"), F.lit(0).alias("s")), F.struct(F.col("_tile2").alias("t"), F.lit(1).alias("s")))).alias("_m"))
        sides = sides.select("_block", "_x", "_y", F.col("_m.t").alias("_tile"), F.col("_m.s").alias("_side"))
        last = store.put("between", _linked(many.drop("_side").join(sides, ["_block", "_tile"]), ["_block", "_x", "_y"], rule))
        links = links.unionByName(more).unionByName(last)

    # every row by the name of its set; rows alone in set and component keep their own id
    comp = components(links, "_a", "_b").select(F.col("node").alias("_rep"), F.col("root").alias("_root"))
    named = reps.join(comp, "_rep", "left").filter("_copies > 1 or _root is not null").select(*name, "_copies", F.coalesce("_root", "_rep").alias("_root"))
    # a set with very many copies is not one task's work: such sets, fewer than MOST_HOT, are broadcast
    named = store.put("named", named.select(*name, "_copies", "_root"))
    total = profiles.count()
    hot = F.broadcast(named.filter(F.col("_copies") * MOST_HOT > total))
    rows = profiles.select("_id", *name)
    cold = rows.join(hot.select(*name), name, "left_anti").join(named.filter(F.col("_copies") * MOST_HOT <= total).select(*name, "_root"), name, "left")
    out = rows.join(hot.select(*name, "_root"), name).unionByName(cold)
    return out.select(F.col("_id").cast(kind).alias(key), F.col("_n").alias("n_shingles"), F.coalesce("_root", "_id").cast(kind).alias("component_id"), *(name if with_name else []))


def _each_text(docs: DataFrame, several: DataFrame, rule: Rule, key: str, text: str, tile_shingles: int, tile_sets: int, with_name: bool) -> DataFrame:
    """`link_groups` where some ids stand on different texts: each such text gets an id of its own for the join, and components are named by the ids as given."""
    store, name, kind = _Store(docs), ["_n", "_s1", "_s2"], docs.schema[key].dataType
    rows = store.put("rows", _named(docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")), rule, "_id", "_text", name))
    first, last = rows.agg(F.min("_id"), F.max("_id")).first()
    own = rows.filter("_n > 0").join(several, "_id").select("_id", *name).distinct().withColumn("_number", F.monotonically_increasing_id())
    free = F.lit(last + 1) + F.col("_number") if last < 1 << 61 else F.lit(first - 1) - F.col("_number")
    own = store.put("own", own.select("_id", *name, free.alias("_own")))
    parted = rows.join(own, ["_id", *name], "left").select(F.coalesce("_own", "_id").alias("_node"), "_text")
    found = link_groups(parted, rule, "_node", "_text", tile_shingles, tile_sets, True).join(own.select(F.col("_own").alias("_node"), F.col("_id").alias("_given")), "_node", "left")
    found = store.put("nodes", found.withColumn("_given", F.coalesce("_given", "_node")))
    least = found.groupBy("component_id").agg(F.min("_given").alias("_least"))
    out = found.join(least, "component_id", "left")
    return out.select(F.col("_given").cast(kind).alias(key), "n_shingles", F.col("_least").cast(kind).alias("component_id"), *(name if with_name else []))


def one_of_each(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of linked documents, one of those with the smallest id; rows without text or id stay.

    Where one id stands on different texts, each text is judged for itself: its row stays if its group has no smaller id, and of equal texts under one id one row stays.
    Only rows whose id falls in the bucket of a doubtful id take part in the shuffled join.
    """
    spark, columns = docs.sparkSession, docs.columns
    store = _Store(docs)
    own = {n: fresh(n, columns) for n in ("_gone", "_n", "_s1", "_s2")}
    groups = store.put("found", link_groups(docs, rule, key, text, with_name=True).select(F.col(key).cast("long").alias("_id"), "_n", "_s1", "_s2", F.col("component_id").cast("long").alias("_root")))
    by_set = groups.filter("_id is not null").groupBy("_id", "_n", "_s1", "_s2").agg((F.min("_root") < F.col("_id")).alias("_gone"), F.count(F.lit(1)).alias("_rows"))
    doubt = store.put("doubt", by_set.groupBy("_id").agg(F.count(F.lit(1)).alias("_sets"), F.max("_gone").alias("_some"), F.min("_gone").alias("_all"), F.sum("_rows").alias("_rows")).filter("_some or _rows > 1"))
    sure, some = _parted(docs, key, doubt.select("_id"))
    met = some.join(doubt.select(F.col("_id").alias(own["_gone"]), F.col("_all").alias(own["_n"]), ((F.col("_sets") > 1) | (F.col("_rows") > 1)).alias(own["_s1"])), F.col(key).cast("long") == F.col(own["_gone"]), "left")
    once = met.filter(F.col(own["_gone"]).isNull() | ~F.col(own["_n"]) & ~F.col(own["_s1"])).select(*columns)
    if doubt.filter("_rows > 1").isEmpty():
        return sure.unionByName(once)
    # ids on several rows: of these, sets are made again and rows decided by id and set
    many = met.filter(F.col(own["_s1"]) & ~F.col(own["_n"])).select(*columns)
    named = _named(many, rule, key, text, [own[n] for n in ("_n", "_s1", "_s2")])
    kept = by_set.filter("not _gone").select(F.col("_id").alias(own["_gone"]), *(F.col(n).alias("k" + own[n]) for n in ("_n", "_s1", "_s2")))
    same = [F.col(own[n]) == F.col("k" + own[n]) for n in ("_n", "_s1", "_s2")]
    stays = named.filter(F.col(own["_n"]) > 0).join(kept, [F.col(key).cast("long") == F.col(own["_gone"]), *same], "left_semi").dropDuplicates([key, *(own[n] for n in ("_n", "_s1", "_s2"))])
    empty = named.filter(F.col(own["_n"]) == 0)
    return sure.unionByName(once).unionByName(stays.select(*columns)).unionByName(empty.select(*columns))


def _named(docs: DataFrame, rule: Rule, key: str, text: str, names: list[str]) -> DataFrame:
    """`docs` with three columns that name the set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text):
            n, s1, s2 = set_names(shingle_sets(words_of(buf, offs, SPACED), rule.k))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), pa.array(s1), pa.array(s2)], [*part.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, kinds + "".join(f", `{n}` long" for n in names))
