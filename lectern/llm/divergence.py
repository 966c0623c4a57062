"""How far the sources of a language differ in their words: a chi-square-like sum for every two of them, and the words that set each apart.

Terms of a text are counted in Arrow batches and added up for each language, source and term; each language keeps the terms of at least MIN_DOCS of its
documents. Kept terms are dealt by hash into slices of about SLICE_TERMS ids, the frequent ones first, so a slice is a bounded piece of work however large
the vocabulary. For each (source, count) a bitset holds the ids with just that count. The AND of two such sets and its number of ones is
a joint cell of two sources; a cell times the value f of its two counts, added over all cells, is the pair's value. Cells with a count of zero
follow by complement: ids of a set that no set of the other source has, and ids that neither has.

Values are whole numbers and exact: shares of a billion are taken by long division, so counts up to 10 ** 15 don't overflow.

Defined results: null language, source and text are ''; a row is a document, so repeated rows count again; a source without kept terms has zero counts;
a language without kept terms gives each pair the value 0; a language of one source gives no pairs; equal values are ranked by the item's bytes;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.skew import joined_by_count
from lectern.llm.textwords import ALNUM, LOWER, chunks
from lectern.session import checkpointed

MIN_DOCS = 3
SHARE = 10**9
TOP_TERMS = 200
#: Expected terms of a slice, sources of a tile (a task holds at most two tiles), and cells that are looked at together.
SLICE_TERMS = 1024
TILE = 256
CELLS = 1 << 20
CHUNK_BYTES = 2 << 20
#: Rows of counts that a task holds before it sends them on.
HELD_ROWS = 400_000
#: Terms are runs of letters: A-Z, a-z and all characters above ASCII.
LETTERS = ALNUM.copy()
LETTERS[48:58] = False


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of each term of the texts its text's number, and the terms themselves, A-Z lower-cased."""
    mask = LETTERS[buf]
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    starts, cut = edge[:-1] == 1, offs[1:-1][offs[1:-1] < len(buf)]
    starts[cut] |= mask[cut]  # a text begins amid letters
    start, at = np.flatnonzero(starts), np.flatnonzero(mask)
    ends = np.append(np.searchsorted(at, start), len(at)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(LOWER[buf[at]]))
    return np.searchsorted(offs, start, "right") - 1, words.dictionary_encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: counts of one chunk of texts."""
    for part, buf, offs in chunks(batches, "text", CHUNK_BYTES):
        text_of, words = _terms(buf, offs)
        if not len(words):
            continue
        langs, sources = (part.column(i).dictionary_encode() for i in (0, 1))
        group = np.asarray(langs.indices).astype(np.int64) * len(sources.dictionary) + np.asarray(sources.indices)
        many = len(words.dictionary)
        in_text, n = np.unique(text_of * many + np.asarray(words.indices), return_counts=True)
        key = group[in_text // many] * many + in_text % many
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        group, code = np.divmod(key, many)
        columns = [langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))), words.dictionary.take(pa.array(code)).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.add.reduceat(n[order], first)), pa.array(np.diff(first, append=len(order)))], ["lang", "source", "term", "n", "docs"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task, added up while they are few."""
    held, rows = [], 0
    for batch in _counted(batches):
        held.append(batch)
        rows += len(batch)
        if rows > HELD_ROWS:
            held = _added(held)
            rows = sum(map(len, held))
            if 2 * rows > HELD_ROWS:
                yield from held
                held, rows = [], 0
    yield from _added(held) if held else []


def _added(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    sums = pa.Table.from_batches(batches).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=1 << 16)


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SHARE * (count + 1) / of) by long division, three digits at a time."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def _share_column(count: str, of: str) -> Column:
    return F.expr(f"1 + (CAST({SHARE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(19,0))) div CAST({of} AS DECIMAL(19,0))").cast("long")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_values(source: np.ndarray, count: np.ndarray, word: np.ndarray, bits: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """value[g, h] over the `terms` ids of a slice, from bitsets: set i holds the ids of word[i] with count[i] in source[i]. total is N + V of each source."""
    zero = _share(np.zeros(len(total), np.int64), total)
    value, both = np.zeros((2, len(total), len(total)), np.int64)
    order = np.lexsort((source, word))
    source, word, bits = source[order], word[order], bits[order]
    share, ones = _share(count[order], total[source]), np.bitwise_count(bits).astype(np.int64)
    cuts = np.flatnonzero(np.diff(word, prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        for x in range(a, b, step := max(1, CELLS // (b - a))):  # sets of one word against all sets of that word
            y = min(b, x + step)
            mine = slice(x, y)
            rows, cols = (np.flatnonzero(np.diff(source[s], prepend=-1)) for s in (mine, slice(a, b)))
            here, there = source[mine][rows], source[a:b][cols]
            cell = np.bitwise_count(bits[mine, None] & bits[None, a:b]).astype(np.int64)
            met = np.zeros((y - x, len(total)), np.int64)
            met[:, there] = np.add.reduceat(cell, cols, axis=1)
            i, j = np.nonzero(cell)
            np.multiply.at(cell, (i, j), _apart(share[mine][i], share[a:b][j]))
            value[np.ix_(here, there)] += np.add.reduceat(np.add.reduceat(cell, cols, axis=1), rows, axis=0)
            both[here] += np.add.reduceat(met, rows, axis=0)
            alone = ones[mine, None] - met  # ids of a set that the other source lacks
            value[here] += np.add.reduceat(alone * _apart(share[mine, None], zero), rows, axis=0)
            value[:, here] += np.add.reduceat(alone * _apart(zero, share[mine, None]), rows, axis=0).T
    own = np.bincount(source, ones, len(total)).astype(np.int64)
    return value + (terms - own[:, None] - own + both) * _apart(zero[:, None], zero)


def _tile_values(tile: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Values of all ordered pairs of sources of one or two tiles in one slice. Rows with word -1 name the sources, their N + V and the number of terms."""

    def found(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        named = rows["word"].to_numpy() < 0
        sources, sets = rows[named].sort_values("idx"), rows[~named]
        idx = sources["idx"].to_numpy()
        values = pair_values(np.searchsorted(idx, sets["idx"]), sets["n"].to_numpy(), sets["word"].to_numpy(), sets["bits"].to_numpy().view(np.uint64), np.maximum(sources["n"].to_numpy(), 1), int(sources["bits"].iloc[0]))
        at = idx // tile
        wanted = (at[:, None] != at) if key[2] != key[3] else ~np.eye(len(idx), dtype=bool)
        g, h = np.nonzero(wanted)
        return pd.DataFrame({"lang": key[0], "g": idx[g], "h": idx[h], "value": values[g, h]})

    return found


def counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n occurrences there and total ones in the language, for terms in at least min_docs documents of the language.

    Counts are dealt once, by language and term; a term has at most a row for each source and task that met it. `first` marks one row of each term.
    """
    texts = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    parts = texts.mapInArrow(_gathered, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    sums = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = sums.withColumn("total", F.sum("n").over(term)).withColumn("docs", F.sum("docs").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return marked.filter(F.col("docs") >= min_docs).drop("docs")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, slice_terms: int = SLICE_TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of each group by part `pair`, its `top` own terms by part `term`."""
    own = checkpointed(counts(docs, lang, source, text, min_docs))
    langs = checkpointed(own.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_n")))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count(F.lit(1)).alias("kept_terms"))
    groups = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "kept_terms", "v", "lang_n"])
    order = Window.partitionBy("lang").orderBy("source")
    groups = checkpointed(groups.withColumn("idx", F.row_number().over(order) - 1).withColumn("tiles", F.expr(f"(count(1) OVER (PARTITION BY lang) - 1) div {tile} + 1")))
    rows = joined_by_count(own, groups, ["lang", "source"], "kept_terms")
    return _pairs(rows, groups, slice_terms, tile).unionByName(_terms_apart(rows, top))


def _pairs(rows: DataFrame, groups: DataFrame, slice_terms: int, tile: int) -> DataFrame:
    # ids of a slice are places in the order of its terms; a slice has about slice_terms terms, with a row for each source that has it
    placed = rows.withColumn("slice", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / slice_terms)))
    placed = placed.withColumn("pos", F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy(F.desc("total"), "term")) - 1)
    sets = placed.groupBy("lang", "slice", "idx", "tiles", "n", F.expr("cast(pos div 64 as bigint)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    sizes = rows.filter("first").groupBy("lang", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / slice_terms)).alias("slice")).agg(F.count(F.lit(1)).alias("bits"))
    last = F.greatest(F.ceil(F.col("v") / slice_terms), F.lit(1)) - 1
    names = groups.select("lang", "idx", "tiles", (F.col("group_n") + F.col("v")).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("slice"))
    names = names.join(sizes, ["lang", "slice"], "left").na.fill(0, ["bits"]).withColumn("word", F.lit(-1).cast("long"))
    both = sets.unionByName(names).withColumn("own", F.expr(f"idx div {tile}"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = both.select("lang", "slice", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "idx", "n", "word", "bits")
    values = dealt.groupBy("lang", "slice", "a", "b").applyInPandas(_tile_values(tile), "lang string, g int, h int, value long")
    values = values.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    named = groups.select("lang", "idx", "source")
    values = values.join(named.withColumnsRenamed({"idx": "g"}), ["lang", "g"]).join(named.withColumnsRenamed({"idx": "h", "source": "item"}), ["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return values.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms_apart(rows: DataFrame, top: int) -> DataFrame:
    shares = rows.withColumn("p", _share_column("n", "group_n + v")).withColumn("q", _share_column("total", "lang_n + v")).filter("p > q")
    found = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    # ranks are limited in each task before rows are dealt
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)
