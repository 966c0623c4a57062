"""Bounded samples of labelled rows for fitting the small models of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of a sample: documents of each label. Their texts are read whole, in tasks; what a model learns from them is collected.
MAX_DOCS_PER_LABEL = 1500


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS_PER_LABEL, allowed: Column | None = None) -> DataFrame:
    """_n, _label, text of at most 2 * max_docs documents, those with the least hash of the key for labels 0 and 1.

    `allowed` filters the labelled keys first. Null texts and null labels are left out; of a key with several labels the greatest counts, of
    one with several texts the least. The choice depends on keys and texts only, so it is the same however the tables are partitioned.
    """
    known = labels.select(F.col(key), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col(key).isNotNull())
    if allowed is not None:
        known = known.filter(allowed)
    known = known.groupBy(key).agg(F.max("_label").alias("_label"))
    near = None
    for value in (0, 1):  # twice as many as wanted, as some have no text
        part = known.filter(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(2 * max_docs)
        near = part if near is None else near.unionByName(part)
    # at most 4 * max_docs rows, so the broadcast is bounded
    texts = docs.select(key, text).filter(F.col(text).isNotNull()).join(F.broadcast(near), key).groupBy(key, "_label").agg(F.min(text).alias(text))
    order = Window.partitionBy("_label").orderBy(F.xxhash64(key), key)
    return texts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_docs).select("_n", "_label", text)
