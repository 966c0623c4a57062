"""Registries, snapshots and schedules, over tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import records
from lectern.registry import query
from lectern.session import table


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stale(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT doc_id, 'old' AS state, n_chars FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0
UNION ALL SELECT doc_id, 'new', n_chars + 1 FROM documents WHERE doc_id % 4 = 0
""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("state"), "n_chars")
    new = docs.filter("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    return records.upserted(docs.filter("doc_id % 3 <> 0"), new, "doc_id", state=F.lit("new"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascaded_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey")
    return records.cascaded(gone, "o_custkey", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))[0]


@query("""
WITH d AS (SELECT o_orderkey AS key, (o_orderkey % 3)::INT AS missing, CASE WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'downloaded' END AS status FROM orders),
s AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_shipdate >= '1995-01-01')
SELECT key, (CASE WHEN s.key IS NOT NULL THEN 0 ELSE missing + 1 END)::INT AS missing, CASE WHEN s.key IS NULL AND missing + 1 >= 2 THEN 'removed' ELSE status END AS status FROM d LEFT JOIN s USING (key)
""")
def missing_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(k.alias("key"), (k % 3).cast("int").alias("missing"), F.when(k % 5 == 0, "removed").otherwise("downloaded").alias("status"))
    seen = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp'1995-01-01'").select(F.col("l_orderkey").alias("key"))
    return records.crawl_misses(docs, seen)


@query("""
WITH d AS (SELECT o_orderkey AS key, (o_orderkey % 2)::INT AS missing, CASE WHEN o_orderkey % 4 = 0 THEN 'pending' ELSE 'downloaded' END AS status, 1 AS version, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE sha1(o_orderpriority) END AS sha256, [200, 200, 304, 404, 500, NULL][(o_custkey % 6 + 1)::INT] AS http, o_custkey % 7 <> 0 AS tried, CASE WHEN o_custkey % 2 = 0 THEN sha1(o_orderpriority) ELSE sha1(o_orderstatus) END AS sha FROM orders),
o AS (SELECT *, CASE WHEN NOT tried THEN 'untried' WHEN http = 304 THEN 'not_modified' WHEN http = 404 THEN 'missing' WHEN http IS NULL OR http >= 400 THEN 'failed' WHEN sha256 = sha THEN 'unchanged' WHEN sha256 IS NOT NULL THEN 'updated' ELSE 'new_file' END AS outcome FROM d)
SELECT key, outcome, (CASE WHEN outcome = 'missing' THEN missing + 1 WHEN outcome IN ('unchanged', 'updated', 'new_file', 'not_modified') THEN 0 ELSE missing END)::INT AS missing,
  CASE WHEN outcome IN ('unchanged', 'updated', 'new_file') THEN 'downloaded' WHEN outcome = 'missing' AND missing + 1 >= 2 THEN 'removed' WHEN outcome IN ('missing', 'failed') AND status <> 'downloaded' THEN outcome ELSE status END AS status,
  (CASE WHEN outcome = 'updated' THEN version + 1 ELSE version END)::INT AS version, CASE WHEN outcome IN ('unchanged', 'updated', 'new_file') THEN sha ELSE sha256 END AS sha256 FROM o
""")
def download_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    docs = o.select(k.alias("key"), (k % 2).cast("int").alias("missing"), F.when(k % 4 == 0, "pending").otherwise("downloaded").alias("status"), F.lit(1).alias("version"), F.when(k % 4 != 0, F.sha1("o_orderpriority")).alias("sha256"))
    http = F.get(F.array(*[F.lit(x).cast("int") for x in (200, 200, 304, 404, 500, None)]), (c % 6).cast("int"))
    results = o.filter(c % 7 != 0).select(k.alias("key"), F.sha1(F.when(c % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))).alias("sha256"), http.alias("http_status"))
    return records.downloaded(docs, results)


@query("""
WITH old AS (SELECT url, max(page_id) AS page_id, 200 AS status, 'f' || max(page_id) AS html_file, NULL::VARCHAR AS error, max(page_id) AS fetched_at, 'parsed' AS parse_status FROM pages WHERE page_id % 3 <> 0 GROUP BY url),
new AS (SELECT url, CASE WHEN max(page_id) % 2 = 0 THEN 200 ELSE 503 END AS status, CASE WHEN max(page_id) % 2 = 0 THEN 'n' || max(page_id) END AS html_file, NULL::VARCHAR AS error, max(page_id) + 1000 AS fetched_at FROM pages WHERE page_id % 5 <> 0 GROUP BY url)
SELECT coalesce(old.url, new.url) AS url, CASE WHEN new.url IS NULL OR (new.status >= 400 AND old.url IS NOT NULL) THEN old.status ELSE new.status END AS status,
  CASE WHEN new.url IS NULL OR (new.status >= 400 AND old.url IS NOT NULL) THEN old.html_file ELSE new.html_file END AS html_file,
  CASE WHEN new.url IS NOT NULL AND new.status >= 400 AND old.url IS NOT NULL THEN 'HTTP ' || new.status END AS error,
  CASE WHEN new.url IS NULL OR (new.status >= 400 AND old.url IS NOT NULL) THEN old.fetched_at ELSE new.fetched_at END AS fetched_at,
  CASE WHEN new.url IS NULL OR (new.status >= 400 AND old.url IS NOT NULL) THEN old.parse_status END AS parse_status
FROM old FULL JOIN new ON old.url = new.url
""")
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    top = F.max("page_id")
    old = pages.filter("page_id % 3 <> 0").groupBy("url").agg(F.lit(200).alias("status"), F.concat(F.lit("f"), top).alias("html_file"), F.lit(None).cast("string").alias("error"), top.alias("fetched_at"), F.lit("parsed").alias("parse_status"))
    new = pages.filter("page_id % 5 <> 0").groupBy("url").agg(F.when(top % 2 == 0, 200).otherwise(503).alias("status"), F.when(top % 2 == 0, F.concat(F.lit("n"), top)).alias("html_file"), F.lit(None).cast("string").alias("error"), (top + 1000).alias("fetched_at"))
    return records.fetched(old, new)


@query("""
WITH h AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_returnflag, lag(l_returnflag) OVER w AS before FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY (l_shipdate, l_orderkey, l_linenumber, l_partkey)))
SELECT l_suppkey, 1 + count(*) FILTER (before <> l_returnflag) AS versions FROM h GROUP BY l_suppkey
""")
def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    return records.versions(history, "l_suppkey", "at", "l_returnflag").groupBy("l_suppkey").agg(F.max("version").cast("long").alias("versions"))


@query("SELECT sha1(text) AS hash, min(doc_id) AS \"primary\", count(*) AS addresses FROM documents GROUP BY 1")
def primary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha1("text").alias("hash"), F.col("doc_id").alias("found"), "doc_id")
    return records.primary_documents(docs, "hash", "found", "doc_id")


@query("""
WITH d AS (SELECT doc_id, sha1(text) AS hash, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars % 5 END AS depth FROM documents WHERE doc_id % 3 <> 0),
f AS (SELECT sha1(text) AS hash FROM documents GROUP BY 1 HAVING bool_or(doc_id % 2 = 0))
SELECT doc_id, hash, depth, row_number() OVER (PARTITION BY hash ORDER BY depth NULLS LAST, doc_id) = 1 AS "primary" FROM d WHERE hash IN (SELECT hash FROM f)
""")
def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of parsed contents, by depth; texts stand in for files."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("hash"), F.when(k % 3 == 0, "failed").otherwise("downloaded").alias("status"), F.when(k % 7 != 0, F.col("n_chars") % 5).alias("depth"))
    files = docs.groupBy("hash").agg(F.bool_or(k % 2 == 0).alias("parsed"))
    return records.active_sources(docs.select("doc_id", "hash", "status"), files, docs.select("doc_id", "depth"), "hash", "doc_id", "depth").select("doc_id", "hash", "depth", "primary")


@query("""
WITH s AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS slot, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-03-10 01:30:00' + to_hours(CAST(s_suppkey % 5 - 2 AS BIGINT)) END AS next_at, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-03-10 01:30:00' - to_days(CAST(s_suppkey % 10 AS INT)) END AS last_full, s_suppkey % 6 = 0 AS busy, s_suppkey % 7 <> 0 AS processed, TIMESTAMP '2024-03-10 01:30:00' AS now FROM supplier),
w AS (SELECT *, processed AND next_at <= now AND NOT busy AS due, date_trunc('day', now) + to_minutes((slot * 3) % 240) AS win FROM s)
SELECT id, CASE WHEN due AND (last_full IS NULL OR last_full <= now - to_days(7)) THEN 'refresh' WHEN due THEN 'check' END AS job,
  strftime(CASE WHEN coalesce(due, false) OR (processed AND next_at IS NULL) THEN CASE WHEN win > now THEN win ELSE win + to_days(1) END ELSE next_at END, '%Y-%m-%d %H:%M') AS next_check FROM w
""")
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-03-10 01:30:00").cast("timestamp")
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(
        k.alias("id"),
        F.when(k % 4 != 0, F.timestamp_add("HOUR", k % 5 - 2, now)).alias("next_check_at"),
        F.when(k % 3 != 0, F.timestamp_add("DAY", -(k % 10), now)).alias("last_full_at"),
        (k % 6 == 0).alias("busy"),
        (k % 7 != 0).alias("processed"),
    )
    return records.scheduled(sources, now).select("id", "job", F.date_format("next_check_at", "yyyy-MM-dd HH:mm").alias("next_check"))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, min(ts) AS since, count(*) AS events FROM events GROUP BY user_id
""")
def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest_state(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@query("""
SELECT s_suppkey, coalesce(a.n, 0) AS queue_left, coalesce(b.n, 0) AS files_pending, coalesce(c.n, 0) AS pages_pending, coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(c.n, 0) AS work FROM supplier
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_suppkey = s_suppkey
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45 GROUP BY 1) b ON b.l_suppkey = s_suppkey
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_tax > 0.07 AND l_discount = 0 GROUP BY 1) c ON c.l_suppkey = s_suppkey
""")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    parts = [lines.filter(x) for x in ("l_returnflag = 'R'", "l_linestatus = 'O' and l_quantity > 45", "l_tax > 0.07 and l_discount = 0")]
    return records.work_left(table(spark, sf_dir, "supplier"), *parts, "s_suppkey")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'disabled' WHEN c_mktsegment = 'MACHINERY' THEN 'blocked' WHEN c_nationkey % 5 = 0 THEN 'running' WHEN c_nationkey % 5 = 1 THEN 'queued' WHEN c_acctbal < 0 THEN 'failed' WHEN coalesce(n, 0) > 0 THEN 'indexed' ELSE 'pending' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    job = F.when(F.col("c_nationkey") % 5 == 0, "running").when(F.col("c_nationkey") % 5 == 1, "queued").otherwise("none")
    status = records.source_status(F.col("c_acctbal") < -500, F.col("c_mktsegment") == "MACHINERY", job, F.col("c_acctbal") < 0, F.coalesce("n", F.lit(0)))
    return c.select("c_custkey", status.alias("status"))


@query("""
WITH s AS (SELECT c_custkey AS k, c_nationkey::BIGINT AS asked_count, CASE WHEN c_custkey % 2 = 0 THEN 'old' || c_custkey END AS answer_id FROM customer WHERE c_custkey % 3 <> 0),
c AS (SELECT o_custkey AS k, count(*) AS asked_count, 'new' || max(o_orderkey) AS answer_id FROM orders GROUP BY 1)
SELECT coalesce(s.k, c.k) AS k, coalesce(c.asked_count, s.asked_count) AS asked_count, coalesce(s.answer_id, c.answer_id) AS answer_id FROM s FULL JOIN c ON s.k = c.k
""")
def refreshed_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    stored = table(spark, sf_dir, "customer").filter(k % 3 != 0).select(k.alias("k"), F.col("c_nationkey").cast("long").alias("asked_count"), F.when(k % 2 == 0, F.concat(F.lit("old"), k)).alias("answer_id"))
    chosen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("asked_count"), F.concat(F.lit("new"), F.max("o_orderkey")).alias("answer_id"))
    return records.refreshed_suggestions(stored, chosen, ["k"])


@query("""
SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 70 ELSE 75 END + [25, 45, 5, 25][(l_linenumber % 4 + 1)::INT] * least(1.0::DOUBLE, l_quantity / 40), 9) AS percent FROM lineitem
""")
def job_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    stage = F.get(F.array(*[F.lit(s) for s, _ in records.PLANS["backlog"]]), n)
    done = records.percent(F.lit("backlog"), stage, F.col("l_quantity"), F.lit(40.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(done, 9).alias("percent"))
