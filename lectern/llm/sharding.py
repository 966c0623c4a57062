"""Weighted rendezvous sharding with DataFrame functions only.

Every shard scores every key as -ln(u) / weight, u a uniform number from the md5 of key and
shard; the least score wins. A further shard only takes keys that it wins, so no record moves
between older shards. Slots are gapless within a shard without sorting a whole shard in one task:
keys fall into sub-buckets of bounded expected size, sub-bucket counts give the first slots.

Defined results: a null key is placed as the empty string; null and empty texts have no bytes; repeated
rows of one key share a shard and take neighbouring slots; an empty table gives no rows. Weights of zero or less are refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import checkpointed

SHARDS = 40
ROW_BYTES = 16
#: Expected rows of a sub-bucket, at most.
SUB_ROWS = 4096
_DIGITS = 13


def _uniform(key: Column, shard: Column) -> Column:
    """In (0, 1): the first 52 bits of md5(key:shard)."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", key, shard)), 1, _DIGITS), 16, 10).cast("double")
    return (number + 0.5) / F.lit(float(16**_DIGITS))


def _best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct<score,shard> of the winner among shards first, first + 1, ...; the lower shard on a tie."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    score = lambda i: -F.log(_uniform(key, i)) / F.get(w, i - first)
    return F.array_min(F.transform(F.sequence(F.lit(first), F.lit(first + len(weights) - 1)), lambda i: F.struct(score(i).alias("score"), i.alias("shard"))))


def rendezvous(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard, from 0, with the least -ln(u) / weight; the lower shard on a tie."""
    return _best(_key(key), _checked(shards, weights))["shard"]


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def _checked(shards: int, weights: Sequence[float] | None) -> list[float]:
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("one positive weight for each shard is needed")
    return weights


def sub_buckets(rows: int, shards: int, sub_rows: int = SUB_ROWS) -> int:
    """A power of two, so that sub-buckets stay bounded as the table grows."""
    return 2 ** max(0, math.ceil(math.log2(max(1, rows) / (shards * sub_rows))))


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, weights: Sequence[float] | None = None, grown_weight: float = 1.0, sub_rows: int = SUB_ROWS) -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard (the shard with one more shard in place)."""
    weights = _checked(shards, weights)
    subs = sub_buckets(df.count(), shards, sub_rows)
    k = _key(F.col(key))
    sub = (F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long") % subs).cast("int")
    # digests are taken once, and rows without their texts written for the counts and the slots
    keyed = df.select(F.col(key), F.col(text), _best(k, weights).alias("_won"), sub.alias("_sub"))
    newer = _best(k, [grown_weight], shards)
    placed = keyed.select(
        key,
        F.col("_won.shard").alias("shard"),
        "_sub",
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.least(F.col("_won"), newer)["shard"].alias("grown_shard"),
    )
    placed = checkpointed(placed)
    counts = placed.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_sub").orderBy(key, "text_crc32", "size")
    numbered = placed.withColumn("_row", F.row_number().over(within)).join(first, ["shard", "_sub"])
    return numbered.select(key, "size", "text_crc32", "shard", (F.col("_first") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
