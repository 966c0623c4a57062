"""Continuous forms of the log operators, by Structured Streaming. Batch and stream give the same rows."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.session import shared_dir


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the Parquet files of a table in `folder`, with the schema that they have now; the table is a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream has given once all that is there now is read: the rows, or the last row of each key where rows are updated.

    Batches go to the shared folder under their number, so a batch that is tried again replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    spark.createDataFrame([], schema).write.parquet(f"{base}/out/none")  # so that an empty stream reads as an empty table

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/{number:08d}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    started.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{base}/out/*")
    if not keys:
        return rows.drop("_batch")
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_r"))
    return last.select(*keys, "_r.*")


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """window start, kind, calls, value: tumbling days, events later than the watermark left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "event_type", "calls", "value")


def new_visitors(events: DataFrame) -> DataFrame:
    """Each visitor once, at the first event that is seen."""
    return events.select("user_id").dropDuplicates(["user_id"])


def limiter(limit: int, seconds: float) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Accepted events of a key; the state is the times of the last `limit` accepted ones. Events of one batch are taken in time order.

    Of a key's events in a batch only number and time are held, sixteen bytes each; a trigger's `maxFilesPerTrigger` or `maxBytesPerTrigger` bounds a batch.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = deque(state.get[0] if state.exists else [])
        parts = [(f["at"].to_numpy(), f["event_id"].to_numpy()) for f in frames]
        at, ident = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ident, at))
        keep = []
        for i in order.tolist():
            while recent and recent[0] <= at[i] - seconds:
                recent.popleft()
            if len(recent) < limit:
                recent.append(float(at[i]))
                keep.append(i)
        state.update((list(recent),))
        yield pd.DataFrame({"user_id": np.full(len(keep), key[0], np.int64), "event_id": ident[keep].astype(np.int64)})

    return run


def accepted(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """user_id, event_id of events that a sliding window lets through; rejected ones do not count."""
    rows = events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(limiter(limit, seconds), "user_id long, event_id long", "recent array<double>", "update", GroupStateTimeout.NoTimeout)
