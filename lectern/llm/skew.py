"""Joins with tables that count how many rows each key has on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 1000


def joined_by_count(left: DataFrame, right: DataFrame, key: str, count: str, most: int = MOST_HOT) -> DataFrame:
    """`left` joined with `right` on `key`, where each key has one row in `right` that counts its rows in `left` (or more).

    Keys with more than one part in `most` of all counted rows, fewer than `most` keys, are broadcast, so none of them is one task's work; the
    others meet in a shuffled join. `right` should be a written table, as it is read several times.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(right.filter(F.col(count) * most > total))
    rest = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(count) * most <= total), key)
    return left.join(hot, key).unionByName(rest)
