from __future__ import annotations

import hashlib
import uuid

import pytest

from lectern.llm import warc
from lectern.session import shared_dir

ROWS = [
    (5, "http://a/1", "x" * 99, 1),
    (3, "http://a/2", "x" * 99, 1),
    (9, "http://a/3", "y\r\n" * 60 + "é", 1),
    (4, "http://a/4", "y\r\n" * 60 + "é", 1),
    (8, None, "y\r\n" * 60 + "é", 1),
    (1, "http://a\r\nInjected: 1", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9, 1),
    (2, "http://a/5", "", 1),
    (6, "http://a/6", None, 1),
    (7, "http://a/7", "long é ✓ " * 4000, 1),
    (10, "http://a/8", "\r\n\r\n" + "z" * 500 + "\r\n\r\n", 1),
]


@pytest.mark.parametrize("chunk_bytes", [7, 100, 1 << 16])
def test_round_trip(spark, chunk_bytes):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, key int").repartition(3)
    archive = warc.write(pages, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", chunk_bytes=chunk_bytes)
    got = {int(r["key"]): r for r in warc.records(warc.read(spark, archive)).collect()}
    assert len(got) == len(ROWS)
    for i, _, html, _ in ROWS:
        raw = (html or "").encode()
        same = [j for j, _, h, _ in ROWS if h == html and len(raw) >= 100]
        first = min(same, default=i)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["intact"]) == (len(raw), hashlib.sha256(raw).hexdigest(), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", str(first)))
    # what an independent reader that trusts only Content-Length finds
    foreign = warc.read_foreign(spark, archive.path).collect()
    whole = {}
    for r in foreign:
        whole.setdefault(int(r["headers"]["lectern-key"]), []).append((int(r["headers"].get("warc-segment-number", 1)), bytes(r["payload"])))
    for i, _, html, _ in ROWS:
        if got[i]["record_type"] == "response":
            assert b"".join(b for _, b in sorted(whole[i])) == (html or "").encode()


def test_running_digest_needs_every_chunk(spark):
    rows = [("r", 1, False, bytearray(b"ab")), ("r", 3, True, bytearray(b"c"))]
    chunks = spark.createDataFrame(rows, "record_id string, chunk_no int, last boolean, payload binary")
    with pytest.raises(Exception, match="chunk 3 follows chunk 1"):
        warc.running_digests(chunks).collect()


def test_empty_table_and_equal_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(warc.read(spark, warc.write(empty, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"))).count() == 0
    twice = spark.createDataFrame([(1, "u", "q" * 200), (1, "u", "q" * 200)], "page_id long, url string, html string")
    got = warc.records(warc.read(spark, warc.write(twice, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"))).collect()
    assert [(r["record_type"], r["refers_to"]) for r in got] == [("response", None)] * 2
