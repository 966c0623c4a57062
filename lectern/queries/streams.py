"""Streaming queries, run until all that is there is read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.queries.analytics import RATE_LIMITED
from lectern.registry import query
from lectern.session import shared_dir, table
from lectern.streaming import frames, usage


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.source(spark, sf_dir, "events")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS calls, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def stream_usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.drained(usage.daily_usage(_events(spark, sf_dir)), "update", ["day", "event_type"])
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "calls", F.round("value", 6).alias("value"))


@query("SELECT DISTINCT user_id FROM events")
def stream_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.drained(usage.new_visitors(_events(spark, sf_dir)), "append")


@query(RATE_LIMITED)
def stream_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.drained(usage.accepted(_events(spark, sf_dir), 3, 21600), "update")


def _written(rows: DataFrame, place: Column, last: DataFrame | None = None) -> DataFrame:
    """`rows` as a stream over four files, read one at a time: what belongs together comes in several batches and out of order. `last` comes after all others."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    rows.withColumn("_f", (place % 4).cast("int")).repartition(4, "_f").drop("_f").write.parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT conv_id, turn, role, sha1(text) AS hash FROM conversations WHERE text <> ''")
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as JSON in pieces of forty characters, each piece a server-sent event, and these cut into chunks of 61 bytes wherever they fall; read back as a stream."""
    turns = table(spark, sf_dir, "conversations").filter("text <> ''").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.to_json(F.struct("role", "text")).alias("j"))
    cut = lambda c, n, size: F.transform(F.sequence(F.lit(0), F.floor((size - 1) / n).cast("int")), lambda i: F.substring(c, i * n + 1, F.lit(n)))
    pieces = cut(F.col("j"), 40, F.length("j"))
    framed = F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("event: delta\r\ndata: "), F.to_json(F.struct(p.alias("text"))), F.lit("\r\n\r\n"))), "")
    whole = turns.select("id", F.encode(framed, "UTF-8").alias("b"))
    chunks = whole.select("id", F.posexplode(cut(F.col("b"), 61, F.octet_length("b"))).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("long"))
    groups = turns.count() // frames.TOGETHER + 1
    found = usage.drained(frames.events_of_bytes(_written(chunks, F.col("seq") + F.length("id")), groups).filter("event = 'value'"), "append")
    key = F.split("id", ":")
    out = found.groupBy("id").agg(F.max(F.when(F.col("path") == "role", F.col("value"))).alias("role"), F.max(F.when(F.col("path") == "text", F.col("value"))).alias("text"))
    return out.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "role", F.sha1("text").alias("hash"))


@query("""
WITH t AS (SELECT conv_id, turn, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE trim(text) <> '')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS place, sha1(text) AS hash FROM t WHERE turn % 3 <> 1
""")
def stream_live_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as an answer whose sentences are its turns, in pieces of thirty characters; lines come in a stream of their own, those that two sentences in three cite."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.trim("text")).filter("text <> ''").withColumn("id", F.col("conv_id").cast("string"))
    sentence = F.struct(F.array(F.concat(F.lit("L"), "turn")).alias("refs"), "text")
    said = c.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", sentence.alias("s")))), lambda x: x["s"]).alias("sentences"))
    j = said.select("id", F.to_json(F.struct(F.lit("answered").alias("verdict"), "sentences")).alias("j"))
    at = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("j") - 1) / 30).cast("int")), lambda i: F.substring(F.col("j"), i * 30 + 1, F.lit(30)))
    pieces = j.select("id", F.posexplode(cut).alias("seq", "value"), at.alias("at")).withColumn("seq", F.col("seq").cast("long"))
    lines = c.filter("turn % 3 <> 1").select("id", F.concat(F.lit("L"), "turn").alias("value"), "turn", at.alias("at"))
    # a last line, an hour later, of an answer that is nobody's lets time pass
    later = spark.range(1).select(F.lit("none").alias("id"), F.lit("L").alias("value"), F.lit(0).cast("long").alias("turn"), (at + F.expr("INTERVAL 1 HOUR")).alias("at"))
    lines = lines.select("id", "value", F.col("turn").cast("long").alias("turn"), "at")
    stream = frames.live_answers(_written(pieces, F.col("seq")), _written(lines, F.col("turn"), later))
    shown = usage.drained(stream, "append").filter("event = 'sentence'")
    return shown.select(F.col("id").cast("long").alias("conv_id"), F.col("index").alias("place"), F.sha1("value").alias("hash"))
