"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of words, and of every `SPAN - k + 1` neighbouring k-grams the one with
the least hash is kept. A span of SPAN words that both sides share has the same kept
k-gram on both, so joining the kept ones finds it; each hit is then extended word by word along its
diagonal and counts where at least SPAN words agree. An item of fewer words is one k-gram of its own length.

A benchmark of up to `MAX_BROADCAST_BYTES` text (checked) goes to the tasks as an index and documents are
read once, without a shuffle. A larger one is joined by the hashes of whole spans, `exchange_hits`; both give the same rows.

Defined results: null and empty texts have no words and no hits; an empty benchmark gives no
hits; repeated rows are treated alike; a null item id counts as the empty string; only id and text columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.textwords import ALNUM, Words, chunks, signed, string_bytes, words_of
from lectern.session import shared_dir

SPAN = 10
GRAM = 5
MAX_BROADCAST_BYTES = 32 << 20
#: Bits for each print in a bitmap of prints, and the bits of one bitmap at least and at most (128 MB; beyond that it keeps out less, and loses nothing).
BITS_A_PRINT, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
RESULTS = ["n_words", "n_hit", "items"]


def winnowed(words: Words, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of first words) and hashes of the kept k-grams of texts of `span` words or more."""
    g = words.grams(gram)
    window = span - gram + 1
    if len(g) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[: len(g) - window + 1].copy()
    for j in range(1, window):
        np.minimum(least, g[j : j + len(least)], out=least)
    counts = words.counts
    left = np.repeat(words.first[1:], counts) - np.arange(len(words.hash))  # words to the end of the text
    least[left[: len(least)] < span] = 0  # no whole window begins here
    most = np.zeros(len(g), np.uint64)
    for j in range(window):  # the largest of the minima of the windows over this k-gram
        np.maximum(most[j : j + len(least)], least, out=most[j : j + len(least)])
    kept = np.flatnonzero((g <= most) & (most > 0))
    return kept, g[kept]


class Index:
    """Fingerprints and words of the benchmark items."""

    def __init__(self, ids: list[str], texts: list[str | None], gram: int = GRAM, span: int = SPAN):
        self.gram, self.span, self.ids = gram, span, ids
        words = words_of(*string_bytes(pa.array(texts, pa.large_string())), ALNUM)
        at, prints = winnowed(words, gram, span)
        order = np.argsort(prints, kind="stable")
        self.prints, self.at = prints[order], at[order]
        self.words, self.first, self.item = words.hash, words.first, words.text_of
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        counts = words.counts
        for n in sorted({int(c) for c in counts if 0 < c < span}):
            g, items = words.grams(n), np.flatnonzero(counts == n)
            keys = g[words.first[items]]
            order = np.argsort(keys, kind="stable")
            self.short[n] = keys[order], items[order]

    @staticmethod
    def postings(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every equal pair: the place in `found` and the place in the sorted `keys`."""
        lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        n = hi - lo
        hit = np.repeat(np.arange(len(found)), n)
        return hit, np.repeat(lo, n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)

    def spans(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, word after the last) of the agreeing spans in a chunk."""
        text_of = words.text_of
        at, prints = winnowed(words, self.gram, self.span)
        hit, post = self.postings(self.prints, prints)
        doc_at, item_at = at[hit], self.at[post]
        yield from extended(words, text_of, doc_at, item_at, self)
        for n, (keys, items) in self.short.items():
            left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.hash))
            g = words.grams(n)
            ok = np.flatnonzero(left[: len(g)] >= n)
            hit, post = self.postings(keys, g[ok])
            for p, item in zip(ok[hit].tolist(), items[post].tolist(), strict=True):
                yield int(text_of[p]), item, p, p + n


def extended(words: Words, text_of: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """Hits grown along their diagonals; runs of at least `span` equal words."""
    if not len(doc_at):
        return
    lines = np.unique(np.stack([text_of[doc_at], index.item[item_at], doc_at - item_at], 1), axis=0)
    for text, item, shift in lines.tolist():
        a = max(int(words.first[text]), int(index.first[item]) + shift)
        b = min(int(words.first[text + 1]), int(index.first[item + 1]) + shift)
        same = np.concatenate(([False], words.hash[a:b] == index.words[a - shift : b - shift], [False]))
        turns = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if e - s >= index.span:
                yield text, item, a + s, a + e


def _rows(part: pa.RecordBatch, words: Words, spans: Iterator[tuple[int, int, int, int]], ids: list[str], carried: list[str]) -> pa.RecordBatch:
    marks = np.zeros(len(words.hash) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for text, item, s, e in spans:
        marks[s] += 1
        marks[e] -= 1
        items.setdefault(text, set()).add(ids[item])
    # a span never leaves its text, so the running sum is back at zero between texts
    hit = np.concatenate(([0], np.cumsum(np.cumsum(marks)[:-1] > 0)))
    n_hit = hit[words.first[1:]] - hit[words.first[:-1]]
    rows = len(part)
    return pa.RecordBatch.from_arrays(
        [*(part.column(part.schema.get_field_index(c)) for c in carried), pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(items.get(i, ())) for i in range(rows)], pa.list_(pa.string()))],
        [*carried, "n_words", "n_hit", "items"],
    )


def _schema(df: DataFrame, carried: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried) + ", n_words long, n_hit long, items array<string>"


def broadcast_hits(docs: DataFrame, index: Index, carried: list[str], text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for part, buf, offs in chunks(batches, text):
            words = words_of(buf, offs, ALNUM)
            yield _rows(part, words, ix.spans(words), ix.ids, carried)

    return docs.select(*dict.fromkeys([*carried, text])).mapInArrow(run, _schema(docs, carried))


def least_grams(words: Words, gram: int = GRAM, span: int = SPAN) -> np.ndarray:
    """The least k-gram hash of the `span` words from each word on: the fingerprint that winnowing keeps of this window. Wrong near the ends of texts."""
    g = words.grams(gram)
    most = len(g) - (span - gram)
    if most <= 0:
        return np.zeros(0, np.uint64)
    out = g[:most].copy()
    for j in range(1, span - gram + 1):
        np.minimum(out, g[j : j + most], out=out)
    return out


def _set_bits(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = prints >> np.uint64(64 - int(len(bitmap) * 64).bit_length() + 1)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _windows(df: DataFrame, key: str, text: str, span: int, lengths: list[int] | None = None, bits: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """key, at, n, print, finger of stretches of n words: those of `span` words and short texts as a whole, or with `lengths` all stretches of so many words that `bits` allow.

    finger is the winnowed fingerprint of a stretch of `span` words and the print of a shorter one. Of a document's stretches those go on whose finger is one of the
    benchmark's, and whose print is.
    """
    shared = df.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text):
            words = words_of(buf, offs, ALNUM)
            text_of, counts = words.text_of, np.repeat(words.counts, words.counts)
            left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.hash))
            for n in lengths if lengths is not None else range(1, span + 1):
                g = words.grams(n)
                ok = left[: len(g)] >= n
                if lengths is None and n < span:
                    ok &= counts[: len(g)] == n
                at = np.flatnonzero(ok)
                fingers = least_grams(words, GRAM, span) if n == span else g
                if shared is not None:
                    at = at[_set_bits(shared.value[0], fingers[at])]
                    at = at[_set_bits(shared.value[1], g[at])]
                rows = text_of[at]
                keys = part.column(part.schema.get_field_index(key)).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([keys, pa.array(at - words.first[rows], pa.int64()), pa.array(np.full(len(at), n), pa.int32()), pa.array(signed(g[at])), pa.array(signed(fingers[at]))], [key, "at", "n", "print", "finger"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, at long, n int, print long, finger long")


def _bits(prints: DataFrame, column: str) -> np.ndarray:
    """A bitmap over the leading bits of a column of hashes, of a size by their number."""
    distinct = prints.select(column).distinct()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_PRINT * distinct.count()).bit_length()))
    lead = F.shiftrightunsigned(column, 65 - size.bit_length())
    words = distinct.select(F.shiftrightunsigned(lead, 6).alias("w"), F.lit(1).cast("long").alias("one"), (lead.bitwiseAND(F.lit(63))).cast("int").alias("k"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, k)")).alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def exchange_hits(docs: DataFrame, benchmark: DataFrame, carried: list[str], text: str = "text", item: str = "item_id", span: int = SPAN) -> DataFrame:
    """The same for a benchmark too large to broadcast.

    Winnowed fingerprints of both sides meet in a bitmap whose size follows their number: a document's window of `span` words goes on only if its fingerprint is
    one of a benchmark window. What goes on is extended by an exact join of whole stretches. A run of `span` or more equal words is a run of equal stretches of `span` words, and an item of fewer words is one stretch, so
    the hit words of a document are those of its stretches that some item has too. These meet in a join with one row for each
    stretch of the benchmark; no texts are exchanged, and ids only where a document really holds a stretch of the item. Stretches with the same items count once a
    document. Rows have a number of their own, written with them, so ids may be null or repeated.
    """
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/decontaminate-{uuid.uuid4().hex}"

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    columns = list(dict.fromkeys([*carried, text]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words_of(buf, offs, ALNUM).counts, pa.int64())], [*columns, "n_words"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_words long"
    rows = put("rows", docs.select(*columns).mapInArrow(counted, kinds).withColumn("__row", F.monotonically_increasing_id()))

    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_item"), F.col(text).alias("_text"))
    prints = put("prints", _windows(items, "_item", "_text", span).select("n", "print", "finger", "_item").distinct())
    allowed = _bits(prints, "finger"), _bits(prints, "print")
    prints = prints.drop("finger")
    # which items have a stretch, as a signature: their number and two sums of hashes
    same = ["_c", "_x", "_y"]
    sets = put("sets", prints.groupBy("n", "print").agg(F.count(F.lit(1)).alias("_c"), F.bit_xor(F.xxhash64("_item")).alias("_x"), F.bit_xor(F.xxhash64("_item", F.lit(1))).alias("_y")))
    members = sets.groupBy(*same).agg(F.min(F.struct("n", "print")).alias("_r")).select(*same, "_r.*").join(prints, ["n", "print"]).select(*same, "_item")
    lengths = sorted(r[0] for r in sets.select("n").distinct().collect())

    matched = put("matched", _windows(rows, "__row", text, span, lengths, allowed).join(sets, ["n", "print"]).select("__row", "at", "n", *same))
    ends = matched.groupBy("__row", "at").agg((F.col("at") + F.max("n")).alias("_end"))
    before = F.max("_end").over(Window.partitionBy("__row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("_end") - F.greatest("at", F.coalesce("_before", F.lit(0))))
    hit = ends.withColumn("_before", before).groupBy("__row").agg(F.sum(new).alias("n_hit"))
    named = matched.select("__row", *same).distinct().join(members, same).groupBy("__row").agg(F.array_sort(F.collect_set("_item")).alias("items"))
    found = hit.join(named, "__row")
    nothing = F.array().cast("array<string>")
    return rows.select(*carried, "n_words", "__row").join(found, "__row", "left").select(*carried, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", nothing).alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", max_bytes: int = MAX_BROADCAST_BYTES, carry: list[str] | None = None) -> DataFrame:
    """The key (or the columns to `carry`), n_words, n_hit (words inside shared spans), items (sorted distinct ids with shared spans)."""
    carried = [c for c in carry or [key] if c not in RESULTS]  # a carried column with the name of a result gives way
    size = benchmark.agg(F.sum(F.octet_length(F.col(text)) + 64)).first()[0] or 0
    if size > max_bytes:
        return exchange_hits(docs, benchmark, carried, text, item)
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text)).collect()
    return broadcast_hits(docs, Index([r[0] for r in rows], [r[1] for r in rows]), carried, text)


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns from the output of `find`."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
