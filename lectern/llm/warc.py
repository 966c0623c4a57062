"""WARC archives as chunked record tables.

A payload longer than `chunk_bytes` is written as a segmented record: a first segment and `continuation`
segments with numbers, so reading gives rows (record_id, chunk_no, payload) and no step after the source row
holds a whole payload. The digest of a record is carried from chunk to chunk. Archives are written and read by Spark alone,
gzipped, one file a task. A boundary header with a random token follows the version line and separates records for the reader.

Defined results: a null payload is empty and has one empty chunk; of equal payloads of at least REVISIT_BYTES the row with the
smallest key is the response and the others are revisits (rows that repeat that key are responses too); a null key is written
as the empty string and read as null; other columns are not written; an empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.skew import joined_by_count
from lectern.session import checkpointed

CHUNK_BYTES = 64 << 10
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGEST_BUCKETS = 1 << 18


@dataclass(frozen=True)
class Archive:
    path: str
    token: str

    @property
    def separator(self) -> str:
        return f"WARC/1.1\r\nLectern-Boundary: {self.token}\r\n"


def _records(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """_key, _url, _payload, _bytes, _digest, _first (the key a revisit refers to, else null)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    base = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_payload"))
    base = base.withColumn("_bytes", F.octet_length("_payload").cast("long")).withColumn("_digest", F.sha2("_payload", 256))
    bucket = (F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") % DIGEST_BUCKETS).cast("int")
    base = base.withColumn("_bucket", bucket)
    # keys and digests alone say which rows are revisits
    narrow = checkpointed(base.select("_key", "_bytes", "_digest", "_bucket"))
    again = narrow.filter(F.col("_bytes") >= REVISIT_BYTES).groupBy("_digest", "_bytes", "_bucket").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = checkpointed(again)
    # a table of at most DIGEST_BUCKETS buckets keeps payloads without a copy out of the shuffled join
    wanted = F.broadcast(again.select("_bucket").distinct())
    none = F.lit(None).cast(pages.schema[key].dataType)
    alone = base.join(wanted, "_bucket", "left_anti").withColumn("_first", none)
    # the others meet their verdict by key and digest, so that a payload with very many copies is dealt over all tasks
    revisits = joined_by_count(narrow.select("_key", "_digest"), again.select("_digest", "_first", "_n"), "_digest", "_n").filter("not _first <=> _key").select(F.col("_key").alias("_k"), F.col("_digest").alias("_d"), "_first").distinct()
    some = base.join(wanted, "_bucket", "left_semi").join(revisits, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d")), "left")
    columns = ["_key", "_url", "_payload", "_bytes", "_digest", "_first"]
    return alone.select(*columns).unionByName(some.select(*columns))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string")))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write one record for each row of `pages` under `path`."""
    archive = Archive(path, uuid.uuid4().hex)
    rows = _records(pages, key, url, payload).withColumn("_id", F.expr("uuid()"))
    revisit = F.col("_first").isNotNull()
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("_payload"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / chunk_bytes)).cast("int")
    # numbers first, then each row cuts its own chunk
    rows = rows.withColumn("_chunks", n).withColumn("_no", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    rows = rows.withColumn("_chunk", F.substring(body, F.col("_no") * chunk_bytes + 1, F.lit(chunk_bytes))).drop("_payload")
    first, last, many = F.col("_no") == 0, F.col("_no") == F.col("_chunks") - 1, F.col("_chunks") > 1
    one_line = F.regexp_replace(F.coalesce("_url", F.lit("")), r"[\r\n]+", " ")
    header = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), "_id", F.when(first, "").otherwise(F.concat(F.lit("-"), F.col("_no") + 1)), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), one_line),
        F.concat(F.lit("Lectern-Key: "), F.coalesce(F.col("_key").cast("string"), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "_digest"),
        F.when(revisit & first, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(first, _field("Lectern-Refers-To", F.col("_first"))),
        F.when(many, _field("WARC-Segment-Number", F.col("_no") + 1)),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: <urn:uuid:"), "_id", F.lit(">"))),
        F.when(many & last, _field("WARC-Segment-Total-Length", F.col("_bytes"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        _field("Content-Length", F.octet_length("_chunk")),
    )
    value = F.concat(F.lit(archive.separator), header, F.lit("\r\n\r\n"), F.col("_chunk").cast("string"), F.lit("\r\n"))
    rows.select(value.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    return archive


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """The chunk table: record_id, chunk_no (from 1), last, key, url, record_type, refers_to, said_digest, payload."""
    raw = spark.read.option("lineSep", archive.separator).text(archive.path).filter(F.col("value") != "")
    raw = raw.withColumn("_head", F.substring_index("value", "\r\n\r\n", 1))
    field = lambda name: F.nullif(F.regexp_extract("_head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    segment = field("WARC-Segment-Number").cast("int")
    payload = F.substring(F.col("value").cast("binary"), F.octet_length("_head") + 5, field("Content-Length").cast("int"))
    name = lambda f: F.regexp_extract(f, "<urn:uuid:([^>]*)>", 1)
    return raw.select(
        F.coalesce(name(field("WARC-Segment-Origin-ID")), name(field("WARC-Record-ID"))).alias("record_id"),
        F.coalesce(segment, F.lit(1)).alias("chunk_no"),
        (segment.isNull() | field("WARC-Segment-Total-Length").isNotNull()).alias("last"),
        field("Lectern-Key").alias("key"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        field("Lectern-Refers-To").alias("refers_to"),
        F.regexp_extract("_head", r"(?m)^WARC-Payload-Digest: sha256:([0-9a-f]+)", 1).alias("said_digest"),
        payload.alias("payload"),
    )


def running_digests(chunks: DataFrame) -> DataFrame:
    """record_id, chunk_no, last, bytes_so_far, digest_so_far: SHA-256 carried over the chunks of each record in order.

    A task sees one chunk at a time. A chunk that does not follow the one before raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, number, size, state = None, 0, 0, hashlib.sha256()
        for batch in batches:
            sizes, digests = [], []
            for i in range(batch.num_rows):
                rid, no = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if rid != record:
                    record, number, size, state = rid, 0, 0, hashlib.sha256()
                if no != number + 1:
                    raise ValueError(f"record {rid}: chunk {no} follows chunk {number}")
                chunk = batch.column(3)[i].as_buffer()
                state.update(chunk)
                number, size = no, size + chunk.size
                sizes.append(size)
                digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["record_id", "chunk_no", "last", "bytes_so_far", "digest_so_far"])

    rows = chunks.select("record_id", "chunk_no", "last", "payload").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return rows.mapInArrow(run, "record_id string, chunk_no int, last boolean, bytes_so_far long, digest_so_far string")


def records(chunks: DataFrame) -> DataFrame:
    """One row a record: key, url, record_type, refers_to, payload_bytes, payload_digest, intact.

    Size and digest are computed from the chunks read, those of a revisit from the response that it refers to; `intact` tells
    whether the digest is the one in the record's header. Records of one chunk are digested in place, others by running digest.
    """
    head = chunks.filter("chunk_no = 1").select("record_id", "key", "url", "record_type", "refers_to", "said_digest", "last", "payload")
    whole = head.filter("last").select("record_id", "key", "url", "record_type", "refers_to", "said_digest", F.octet_length("payload").cast("long").alias("_bytes"), F.sha2("payload", 256).alias("_digest"))
    ends = running_digests(chunks.filter("not (last and chunk_no = 1)")).filter("last").select("record_id", F.col("bytes_so_far").alias("_bytes"), F.col("digest_so_far").alias("_digest"))
    long = head.filter("not last").drop("last", "payload").join(ends, "record_id")
    found = checkpointed(whole.unionByName(long))  # narrow rows, so that archives are not read again for the join below
    responses = found.filter("record_type = 'response'")
    revisits = found.filter("record_type = 'revisit'").drop("_bytes", "_digest")
    # only responses that something refers to take part in the join
    named = revisits.select("refers_to").distinct()
    origin = responses.join(named.withColumnRenamed("refers_to", "key"), "key", "left_semi").select(F.col("key").alias("refers_to"), "_bytes", "_digest").dropDuplicates(["refers_to"])
    both = responses.unionByName(revisits.join(origin, "refers_to", "left"), allowMissingColumns=True)
    return both.select("key", "url", "record_type", "refers_to", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), (F.col("_digest") == F.col("said_digest")).alias("intact"))


def read_foreign(spark: SparkSession, path: str) -> DataFrame:
    """record_type, url, headers, payload of uncompressed or gzipped archives of any origin, by Content-Length.

    A file is read by one task; use `read` for archives written here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                stream = gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                while line := stream.readline():
                    if not line.startswith(b"WARC/"):
                        continue
                    headers = {}
                    while (line := stream.readline().rstrip(b"\r\n")):
                        name, _, value = line.decode("utf-8", "replace").partition(":")
                        headers[name.lower()] = value.strip()
                    body = stream.read(int(headers.get("content-length", 0)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([headers.get("warc-type")], pa.string()), pa.array([headers.get("warc-target-uri")], pa.string()), pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([body], pa.binary())],
                        ["record_type", "url", "headers", "payload"],
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record_type string, url string, headers map<string,string>, payload binary")
