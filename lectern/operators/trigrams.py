"""Substring search in lines by an index of trigrams.

The index is three tables in one folder: postings (for each gram and block of lines the pieces of the block that hold it), counts of pieces by gram, and the lines. A piece
is a few lines that follow each other, a block many pieces. Postings lie in folders by hash of the gram and are sorted by it, lines in folders by block, so a search reads the
folders of its rarest grams, intersects them, and reads only the folders of candidate lines, which are compared with the text itself. A text of fewer than three characters has no
gram, and all lines are scanned for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import checkpointed

BUCKETS = 64
#: Lines of a piece and of a block, as powers of two; characters and lines that a task numbers the grams of at a time (one line may be longer).
PIECE, BLOCK = 4, 14
SLICE_CHARS, SLICE_LINES = 1 << 21, 1 << 12
#: Grams of a text that are intersected, the rarest first, and rows of asked grams that may be broadcast.
RAREST = 6
MOST_GRAMS = 100_000


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, none of one with fewer than three characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int").alias("bucket")


def _code(gram: Column) -> Column:
    """A gram as one number, 21 bits a character."""
    at = lambda i: F.ascii(F.substring(gram, i, 1)).cast("long")
    return F.shiftleft(at(1), 42) + F.shiftleft(at(2), 21) + at(3)


def _pieces_of_grams(blocks: np.ndarray, pieces: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """gram, block, pieces, n of lines that follow each other."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.asarray(pc.utf8_length(texts), np.int64)
    line = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    unit = np.cumsum(np.append(0, (np.diff(blocks) != 0) | (np.diff(pieces) != 0)))
    first = np.flatnonzero(np.diff(unit, prepend=-1))
    there = np.zeros(0x110000, bool)
    there[points] = True
    known = np.flatnonzero(there)
    # characters by their number among those that are there, so a gram and a unit are one number: 3 * 17 + 12 bits, or one line's 63
    bits, unit_bits = max(1, int(len(known) - 1).bit_length()), int(unit[-1]).bit_length()
    c = (np.cumsum(there) - 1)[points].astype(np.int64)
    whole = line[:-2] == line[2:]
    keys = (((c[:-2] << bits | c[1:-1]) << bits | c[2:]) << unit_bits)[whole] | unit[line[:-2][whole]]
    keys = np.sort(keys)
    keys = keys[np.diff(keys, prepend=-1) != 0]
    of, gram = first[keys & ((1 << unit_bits) - 1)], keys >> unit_bits
    begin = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(blocks[of], prepend=-1) != 0))
    own, mask = gram[begin], (1 << bits) - 1
    code = known[own >> 2 * bits] << 42 | known[own >> bits & mask] << 21 | known[own & mask]
    ends = np.append(begin, len(keys)).astype(np.int32)
    held = pa.ListArray.from_arrays(pa.array(ends), pa.array(pieces[of].astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(blocks[of[begin]]), held, pa.array(np.diff(ends))], ["gram", "block", "pieces", "n"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, pieces = (np.asarray(batch.column(c)) for c in ("block", "piece"))
        ends = np.cumsum(np.asarray(pc.utf8_length(batch.column("text")), np.int64))
        at = 0
        while at < len(ends):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_CHARS, "right"))
            stop = max(at + 1, min(upto, at + SLICE_LINES))
            if ends[stop - 1] - (ends[at - 1] if at else 0) >= 3:
                yield _pieces_of_grams(blocks[at:stop], pieces[at:stop], batch.column("text").slice(at, stop - at))
            at = stop


def build(lines: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the index of lines (key, idx, line) to a new folder. Lines are read where they are; what is exchanged is a list of pieces for each gram and block."""
    n = F.col("_n")
    place = {"block": F.shiftright(n, BLOCK), "piece": F.shiftright(n.bitwiseAND(F.lit((1 << BLOCK) - 1)), PIECE).cast("int")}
    rows = lines.select(key, "idx", "line").withColumn("_n", F.monotonically_increasing_id()).withColumns(place).drop("_n")
    rows.withColumn("bucket", _bucket("block")).write.partitionBy("bucket").parquet(f"{path}/lines")
    spark = lines.sparkSession
    texts = spark.read.parquet(f"{path}/lines").filter("line is not null").select("block", "piece", F.lower("line").alias("text"))
    postings = texts.mapInArrow(_postings, "gram long, block long, pieces array<int>, n int").withColumn("bucket", _bucket("gram"))
    postings.repartition("bucket", F.pmod("block", F.lit(4))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum("n").alias("docs")).write.parquet(f"{path}/counts")


def _only(table: DataFrame, buckets: DataFrame) -> DataFrame:
    """The folders that are wanted, BUCKETS at most."""
    return table.filter(F.col("bucket").isin([r[0] for r in buckets.select("bucket").distinct().collect()]))


def search(spark: SparkSession, path: str, texts: DataFrame, limit: int | None = None, key: str = "doc_id", name: str = "text_id", text: str = "text") -> DataFrame:
    """name, key, idx, line: the lines that hold each text (its case aside), the first `limit` of each by key and place."""
    asked = checkpointed(texts.select(name, F.lower(text).alias("_text")))
    counts = spark.read.parquet(f"{path}/counts")
    wanted = asked.filter(F.length("_text") >= 3).select(name, F.explode(F.transform(grams(F.col("_text")), _code)).alias("gram"))
    few = wanted.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS
    put = F.broadcast if few else lambda df: df
    known = counts.join(put(wanted), "gram")
    # a text with a gram that no line has is nowhere
    whole = known.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(name))).join(wanted.groupBy(name).agg(F.count(F.lit(1)).alias("_need")), name).filter("_all = _need")
    rare = whole.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy("docs", "gram"))).filter(F.col("_n") <= RAREST)
    bit = F.expr("shiftleft(1, _n - 1)")
    rare = checkpointed(rare.select(name, "gram", bit.alias("_bit"), F.expr(f"shiftleft(1, int(least(_need, {RAREST}))) - 1").alias("_all"), _bucket("gram")))
    postings = _only(spark.read.parquet(f"{path}/postings"), rare).select("gram", "block", "pieces")
    met = postings.join(put(rare.drop("bucket")), "gram").select(name, "_bit", "_all", "block", F.explode("pieces").alias("piece"))
    both = met.groupBy(name, "block", "piece").agg(F.bit_or("_bit").alias("_met"), F.first("_all").alias("_all")).filter("_met = _all")
    candidates = checkpointed(both.select(name, "block", "piece").withColumn("bucket", _bucket("block")))
    lines = spark.read.parquet(f"{path}/lines").withColumn("_low", F.lower("line"))
    found = _only(lines, candidates).join(candidates, ["bucket", "block", "piece"]).join(asked, name)
    found = found.filter(F.contains("_low", F.col("_text"))).select(name, key, "idx", "line")
    short = asked.filter(F.length("_text").between(1, 2))
    if short.limit(1).count():
        found = found.unionByName(lines.join(F.broadcast(short) if few else short, F.contains("_low", F.col("_text"))).select(name, key, "idx", "line"))
    if limit is None:
        return found
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(key, "idx"))).filter(F.col("_n") <= limit).drop("_n")
