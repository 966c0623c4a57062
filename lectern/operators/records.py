"""Registries of pages, files and documents: upserts, state changes, work lists, schedules. Pure functions from tables to tables.

A table is a snapshot; a change gives the next snapshot, written by `lectern.sources.snapshots`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import shared_dir

CHECK_EVERY_HOURS, FULL_EVERY_DAYS, SPREAD_MINUTES, WINDOW_MINUTES = 6, 7, 3, 240


def upserted(existing: DataFrame, new: DataFrame, key: str, **reset: Column) -> DataFrame:
    """Rows of `new` in place of those with the same key; columns named in `reset` start over for them."""
    for name, value in reset.items():
        new = new.withColumn(name, value)
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def inserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`existing` and the rows of `new` whose key it lacks."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def stale(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows whose key is no longer current."""
    return existing.join(current.select(key).distinct(), key, "left_anti")


def cascaded(gone: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Tables without the rows of deleted keys."""
    keys = gone.select(key).distinct()
    return [t.join(keys, key, "left_anti") for t in tables]


def fetched(pages: DataFrame, results: DataFrame, key: str = "url") -> DataFrame:
    """Pages after a crawl: a good fetch replaces a row and its parse starts over; a failed one of a page with a good copy only
    notes the error; a failed one of a new page is recorded.

    results: url, status, html_file, error, fetched_at.
    """
    old = pages.select(key, *(F.col(c).alias(f"_{c}") for c in pages.columns if c != key), F.lit(True).alias("_known"))
    both = old.join(results.withColumn("_seen", F.lit(True)), key, "full_outer")
    failed = F.col("_seen") & (F.col("status").isNull() | (F.col("status") >= 400))
    good_copy = F.coalesce((F.col("_status") < 400) & F.col("_html_file").isNotNull(), F.lit(False))
    keep = F.col("_seen").isNull() | (failed & good_copy)
    out = [F.col(key)]
    for c in pages.columns:
        if c == key:
            continue
        new = F.col(c) if c in results.columns else F.lit(None).cast(pages.schema[c].dataType)
        if c == "error":
            noted = F.coalesce(F.col("error"), F.concat(F.lit("HTTP "), F.col("status")))
            out.append(F.when(F.col("_seen").isNull(), F.col("_error")).when(keep, noted).otherwise(new).alias(c))
        else:
            out.append(F.when(keep, F.col(f"_{c}")).otherwise(new).alias(c))
    return both.select(*out)


def unseen_dropped(pages: DataFrame, site: str, since: Column) -> DataFrame:
    """Pages of a site that a complete crawl did not reach are gone."""
    gone = (F.col("site") == site) & (F.col("fetched_at") < since) & (F.col("status").isNull() | (F.col("status") < 400))
    return pages.withColumns({"status": F.when(gone, 410).otherwise(F.col("status")), "error": F.when(gone, "not reached by the last complete crawl").otherwise(F.col("error"))})


def crawl_misses(documents: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    """After a complete crawl: a document that was seen starts counting again, another is missing once more and removed at the second time in a
    row. A removed document stays so when it is seen."""
    marked = documents.join(seen.select(key, F.lit(True).alias("_seen")).distinct(), key, "left")
    missing = F.when(F.col("_seen"), 0).otherwise(F.col("missing") + 1)
    return marked.withColumns({"missing": missing, "status": F.when(missing >= 2, "removed").otherwise(F.col("status"))}).drop("_seen")


def download_outcome(old_sha: Column, new_sha: Column, http_status: Column, known: Column) -> Column:
    """What a download amounts to."""
    return (
        F.when(http_status == 304, "not_modified")
        .when(http_status.isin(404, 410), "missing")
        .when(http_status.isNull() | (http_status >= 400), "failed")
        .when(old_sha == new_sha, "unchanged")
        .when(old_sha.isNotNull(), "updated")
        .when(known, "duplicate")
        .otherwise("new_file")
    )


def downloaded(documents: DataFrame, results: DataFrame, key: str = "key") -> DataFrame:
    """Documents after downloads (key, sha256, http_status): new content at a known address is the next version; a first 404 keeps a downloaded
    copy, a second removes it; a failure keeps it; success and 304 reset the misses."""
    r = results.select(key, F.col("sha256").alias("_sha"), F.col("http_status").alias("_http"), F.lit(True).alias("_tried"))
    both = documents.join(r, key, "left")
    outcome = download_outcome(F.col("sha256"), F.col("_sha"), F.col("_http"), F.lit(False))
    o = F.when(F.col("_tried"), outcome)
    got = o.isin("unchanged", "updated", "new_file")
    missing = F.when(o == "missing", F.col("missing") + 1).when(got | (o == "not_modified"), 0).otherwise(F.col("missing"))
    status = (
        F.when(got, "downloaded")
        .when((o == "missing") & (F.col("missing") + 1 >= 2), "removed")
        .when(o.isin("missing", "failed") & (F.col("status") != "downloaded"), o)
        .otherwise(F.col("status"))
    )
    version = F.when(o == "updated", F.col("version") + 1).otherwise(F.col("version"))
    sha = F.when(got, F.col("_sha")).otherwise(F.col("sha256"))
    new = {"missing": missing, "status": status, "version": version, "sha256": sha, "outcome": F.coalesce(o, F.lit("untried"))}
    return both.select(*[c for c in documents.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def versions(history: DataFrame, key: str, order: str, sha: str) -> DataFrame:
    """Each download with its version: one more whenever the content differs from the one before."""
    w = Window.partitionBy(key).orderBy(order)
    changed = (F.lag(sha).over(w) != F.col(sha)).cast("int")
    return history.withColumn("_c", F.coalesce(changed, F.lit(0))).withColumn("version", (1 + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int")).drop("_c")


def primary_documents(rows: DataFrame, sha: str, discovered: str, key: str) -> DataFrame:
    """One row a content: the address found first, and how many it has. A grouped minimum, whatever the number of addresses."""
    first = F.min(F.struct(discovered, key))
    return rows.groupBy(sha).agg(first[key].alias("primary"), F.count(F.lit(1)).alias("addresses"))


def active_sources(documents: DataFrame, files: DataFrame, sources: DataFrame, sha: str, key: str, depth: str) -> DataFrame:
    """Addresses of documents that are downloaded and parsed, with `primary` for the one of each content that stands least deep, unknown depths last, then by key.

    documents: key, sha, status; files: sha, parsed; sources: key, depth.
    """
    ready = documents.filter("status = 'downloaded'").join(files.filter("parsed").select(sha), sha, "left_semi").join(sources.select(key, depth), key, "left")
    best = ready.groupBy(sha).agg(F.min(F.struct(F.col(depth).isNull().alias("u"), F.col(depth).alias("d"), F.col(key).alias("k"))).alias("_b"))
    return ready.join(best, sha).withColumn("primary", F.col(key) == F.col("_b.k")).drop("_b")


def next_check(next_at: Column, last_at: Column, now: Column) -> Column:
    """A signal moves the next check forward, but not within six hours of the last."""
    earliest = F.greatest(now, F.coalesce(last_at + F.expr(f"INTERVAL {CHECK_EVERY_HOURS} HOURS"), now))
    return F.coalesce(F.least(next_at, earliest), earliest)


def night_slot(now: Column, slot: Column, hour: int = 0) -> Column:
    """The next time of a slot in the night window."""
    minutes = F.pmod(slot * SPREAD_MINUTES, F.lit(WINDOW_MINUTES)) + hour * 60
    at = F.timestamp_add("MINUTE", minutes, F.date_trunc("day", now))
    return F.when(at > now, at).otherwise(at + F.expr("INTERVAL 1 DAY"))


def scheduled(sources: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """job (check, refresh or null) and new next_check_at for sources with next_check_at, last_full_at, busy and processed.

    The slot is a source's place by id: its place in a range of ids and the sizes of the ranges before, so no task sorts all sources.
    """
    slotted = numbered(sources, [key], "_slot")
    due = F.col("processed") & (F.col("next_check_at") <= now) & ~F.col("busy")
    full = F.col("last_full_at").isNull() | (F.col("last_full_at") <= now - F.expr(f"INTERVAL {FULL_EVERY_DAYS} DAYS"))
    fresh = F.col("processed") & F.col("next_check_at").isNull()
    at = F.when(due | fresh, night_slot(now, F.col("_slot"))).otherwise(F.col("next_check_at"))
    return slotted.withColumns({"job": F.when(due & full, "refresh").when(due, "check"), "next_check_at": at}).drop("_slot")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with their place in the order, from 0. They are dealt by ranges of the order and written; across ranges only their sizes are summed."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range; as many ranges as the shuffle has partitions
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_range", "_in", "_before")


def source_status(disabled: Column, blocked: Column, job: Column, failed: Column, indexed: Column) -> Column:
    """The first that holds: disabled, blocked, running or queued, failed, indexed, pending."""
    return F.when(disabled, "disabled").when(blocked, "blocked").when(job.isin("running", "queued"), job).when(failed, "failed").when(indexed > 0, "indexed").otherwise("pending")


def latest_state(events: DataFrame, key: str, at: str, state: str, tie: str) -> DataFrame:
    """The last state of each job, its first time and the number of its events."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, tie)).alias(state), F.min(at).alias("since"), F.count(F.lit(1)).alias("events"))


def work_left(sources: DataFrame, queue: DataFrame, files: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Counts of three kinds of work for each source, none missing, and their sum."""
    out = sources.select(key)
    names = ["queue_left", "files_pending", "pages_pending"]
    for df, name in zip((queue, files, pages), names, strict=True):
        out = out.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return out.na.fill(0, names).withColumn("work", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def refreshed_suggestions(stored: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Stored suggestions after a round: new counts where chosen again, an earlier answer kept where none is new, others as they were.

    Both hold the keys, asked_count and answer_id.
    """
    s = stored.select(*keys, F.col("asked_count").alias("_n"), F.col("answer_id").alias("_a"))
    both = s.join(chosen.select(*keys, "asked_count", "answer_id"), keys, "full_outer")
    return both.select(*keys, F.coalesce("asked_count", "_n").alias("asked_count"), F.coalesce("_a", "answer_id").alias("answer_id"))


def grouped_decisions(rows: DataFrame, decisions: DataFrame, key: str, group: str) -> DataFrame:
    """Groups of rows joined by stored decisions (key of a group's head, its new group); a head without a decision keeps its group."""
    return rows.join(decisions.select(F.col(key).alias(group), F.col("decided").alias("_d")), group, "left").withColumn(group, F.coalesce("_d", group)).drop("_d")


#: Stages of a job by kind, with the share of its time that each takes.
PLANS = {
    "full": [("crawl", 30), ("download", 20), ("parse", 30), ("chunk", 5), ("index", 15)],
    "refresh": [("crawl", 30), ("download", 20), ("parse", 30), ("chunk", 5), ("index", 15)],
    "check": [("detect", 40), ("download", 20), ("parse", 20), ("chunk", 5), ("index", 15)],
    "backlog": [("download", 25), ("parse", 45), ("chunk", 5), ("index", 25)],
}


def percent(kind: Column, stage: Column, done: Column, total: Column) -> Column:
    """How far a job is: the weight of its finished stages and the share done of the present one."""
    out = F.lit(None).cast("double")
    for name, steps in PLANS.items():
        before = 0
        for step, weight in steps:
            share = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(0.0)
            out = F.when((kind == name) & (stage == step), before + weight * share).otherwise(out)
            before += weight
    return out
