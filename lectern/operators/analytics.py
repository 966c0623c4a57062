"""Reports over logs: usage and spending, feedback, visitors, questions, gaps, evaluation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import dealt, shared_dir

TIME_ZONE = "Europe/Chisinau"
MILLION = 1_000_000
LEADER_BLOCK = 4096


def local_day(at: Column, zone: str = TIME_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def prices(spark: SparkSession, table: Mapping[str, tuple[float, float]]) -> DataFrame:
    """model_name, price_in, price_out per million; a price list is a setting of a few rows."""
    return spark.createDataFrame([(k, *v) for k, v in table.items()], "model_name string, price_in double, price_out double")


def priced(df: DataFrame, price_list: DataFrame, model: str, separators: str = "-:") -> DataFrame:
    """Rows with the price of their model: its own, else that of the longest listed name that it continues after a separator.

    Every prefix that ends before a separator becomes a key, so the match is an equi-join on distinct models, not a theta join on calls.
    """
    names = df.select(model).distinct()
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(model))), lambda i: F.substring(F.col(model), i + 1, F.lit(1)).isin(list(separators)) | (i == F.length(model)))
    prefixes = names.select(model, F.explode(F.transform(ends, lambda i: F.substring(F.col(model), F.lit(1), i))).alias("model_name"))
    best = prefixes.join(price_list, "model_name").groupBy(model).agg(F.max_by(F.struct("price_in", "price_out"), F.length("model_name")).alias("_p"))
    return df.join(best, model, "left").select(*df.columns, F.col("_p.price_in").alias("price_in"), F.col("_p.price_out").alias("price_out"))


def cost(price_in: Column, price_out: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Null without a price."""
    return (tokens_in * price_in + tokens_out * price_out) / MILLION


def usage_groups(calls: DataFrame, by: list[str]) -> DataFrame:
    """calls, input_tokens and output_tokens by day and other columns: the small table that all reports start from."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def totals(groups: DataFrame, today: Column, days: int) -> DataFrame:
    """One row: calls, cost and unpriced calls of today, this month, the last `days` days and ever, and the month's forecast."""
    spans = {"today": F.col("day") == today, "month": F.col("day") >= F.trunc(today, "month"), "range": F.col("day") > F.date_sub(today, days), "all": F.lit(True)}
    out = []
    for name, inside in spans.items():
        out.append(F.coalesce(F.sum(F.when(inside, F.col("calls"))), F.lit(0)).alias(f"{name}_calls"))
        out.append(F.coalesce(F.sum(F.when(inside, F.col("cost"))), F.lit(0.0)).alias(f"{name}_cost"))
        out.append(F.coalesce(F.sum(F.when(inside & F.col("cost").isNull(), F.col("calls"))), F.lit(0)).alias(f"{name}_unpriced"))
    row = groups.agg(*out)
    return row.withColumn("month_forecast", F.col("month_cost") / F.dayofmonth(today) * F.dayofmonth(F.last_day(today)))


def daily(groups: DataFrame, today: Column, days: int) -> DataFrame:
    """Calls and cost of each of the last `days` days, those without calls too; unpriced calls cost nothing here."""
    spark = groups.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    sums = groups.groupBy("day").agg(F.sum("calls").alias("calls"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    return calendar.join(sums, "day", "left").na.fill(0, ["calls"]).na.fill(0.0, ["cost"])


def histogram(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """value and n for every value from low to high, absent ones with zero."""
    every = df.sparkSession.range(low, high + 1).select(F.col("id").cast(df.schema[value].dataType).alias(value))
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, value, "left").na.fill(0, ["n"])


def top_tags(df: DataFrame, tags: Column, n: int) -> DataFrame:
    """The n most frequent elements of an array column, ties by name."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def top_per_group(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The n most frequent values of each group with their counts, ties by value."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("hits"))
    w = Window.partitionBy(group).orderBy(F.desc("hits"), value)
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def most_common(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the least on a tie."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), value))
    return counts.groupBy(group).agg(best.alias("_b")).select(group, F.col(f"_b.{value}").alias(value), (-F.col("_b.m")).alias("n"))


def latest_ratings(ratings: DataFrame, keys: list[str], at: str, *columns: str) -> DataFrame:
    """One row a rater and answer: the last rating, the first time."""
    row = F.max_by(F.struct(at, *columns), F.struct(at, *columns))
    return ratings.groupBy(*keys).agg(row.alias("_r"), F.min(at).alias("created_at")).select(*keys, "_r.*", "created_at")


def question_candidates(answers: DataFrame, lang: str, key: Column, question: str, good: str, rating: str, answer: str, at: str) -> DataFrame:
    """Questions by normalised wording: the least wording, counts, ratings, whether all answers were good, and the last answer."""
    rows = answers.withColumn("_key", key)
    return rows.groupBy(lang, "_key").agg(
        F.min(question).alias("question"),
        F.count(F.lit(1)).alias("asked_count"),
        F.bool_and(good).alias("always_good"),
        F.avg(rating).alias("rating_avg"),
        F.min(rating).alias("rating_min"),
        F.max_by(answer, F.struct(at, answer)).alias("answer_id"),
    ).drop("_key")


def chosen(candidates: DataFrame, qualifies: Column, least: int = 2) -> DataFrame:
    """Candidates to show: always answered well, not rated badly, asked often enough."""
    fine = F.col("always_good") & qualifies & (F.col("rating_min").isNull() | (F.col("rating_min") > 2)) & (F.col("rating_avg").isNull() | (F.col("rating_avg") >= 4))
    return candidates.filter(fine & (F.col("asked_count") >= least))


def leaders(rows: DataFrame, by: str, order: list[str], key: str, vector: str, threshold: float, strict: bool = False, block: int = LEADER_BLOCK) -> DataFrame:
    """by, key and leader: in order, a row joins the first leader that it is close to, else it leads.

    Rounds over written tables, each of bounded pieces. The first `block` rows of each group that are still open are close to no leader so far, so they settle among
    themselves, in order; then all other open rows are compared, in pieces of `block`, with the leaders that came of it, and those close to one join the first of
    them. A group is done after about as many rounds as it has blocks of leaders, and no task ever holds a group.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/leaders-{uuid.uuid4().hex}"
    kind = lambda c: rows.schema[c].dataType.simpleString()
    place = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([*order, key])])
    columns = ["_g", "_k", "_at", "_v"]

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    def near(v: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The first head that each row is close to, or -1."""
        dots = v @ heads.T
        close = dots > threshold if strict else dots >= threshold
        return np.where(close.any(1), close.argmax(1), -1)

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n")
        v = np.stack([np.asarray(x, float) for x in frame["_v"]])
        heads: list[int] = []
        lead = []
        for i in range(len(v)):
            found = int(near(v[i : i + 1], v[heads])[0]) if heads else -1
            if found < 0:
                heads.append(i)
            lead.append(i if found < 0 else heads[found])
        return frame.assign(_leader=frame["_k"].to_numpy()[lead], _head=np.array(lead) == np.arange(len(v)))

    def compare(left: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left.assign(_leader=None)[["_g", "_k", "_at", "_v", "_leader"]].iloc[:0]
        found = np.full(len(left), -1)
        if len(heads):
            heads = heads.sort_values("_n")
            found = near(np.stack([np.asarray(x, float) for x in left["_v"]]), np.stack([np.asarray(x, float) for x in heads["_v"]]))
            names = heads["_k"].to_numpy()[found]
        out = left[["_g", "_k", "_at", "_v"]].copy()
        out["_leader"] = pd.Series([names[i] if f >= 0 else None for i, f in enumerate(found)], index=out.index, dtype=object)
        return out

    # rows are dealt to pieces by hash, as many pieces as a group's size asks for
    packed = rows.select(F.col(by).alias("_g"), F.col(key).alias("_k"), place.alias("_at"), F.col(vector).alias("_v"))
    open_ = put("open-0", packed)
    schema = f"_g {kind(by)}, _k {kind(key)}, _at {packed.schema['_at'].dataType.simpleString()}, _v {kind(vector)}"
    done = []
    number = 0
    while not open_.isEmpty():
        first = F.row_number().over(Window.partitionBy("_g").orderBy("_at"))
        top = open_.withColumn("_n", first).filter(F.col("_n") <= block)
        settled = put(f"settled-{number}", top.groupBy("_g").applyInPandas(settle, f"{schema}, _n int, _leader {kind(key)}, _head boolean"))
        done.append(settled.select("_g", "_k", "_leader"))
        sizes = open_.groupBy("_g").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > block)
        if sizes.isEmpty():
            break
        pieces = sizes.select("_g", F.ceil(F.col("_size") / block).cast("int").alias("_pieces"))
        ends = settled.groupBy("_g").agg(F.max("_at").alias("_end"))
        left = open_.join(pieces, "_g").join(ends, "_g").filter(F.col("_at") > F.col("_end"))
        left = left.withColumn("_piece", F.pmod(F.xxhash64("_k"), F.col("_pieces"))).select(*columns, "_piece")
        heads = settled.filter("_head").join(pieces, "_g").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).select("_g", "_k", "_v", "_n", "_piece")
        met = put(f"met-{number}", left.groupBy("_g", "_piece").cogroup(heads.groupBy("_g", "_piece")).applyInPandas(compare, f"{schema}, _leader {kind(key)}"))
        done.append(met.filter("_leader is not null").select("_g", "_k", "_leader"))
        open_ = met.filter("_leader is null").drop("_leader")
        number += 1
    out = spark.createDataFrame([], f"_g {kind(by)}, _k {kind(key)}, _leader {kind(key)}")
    for part in done:
        out = out.unionByName(part)
    return out.select(F.col("_g").alias(by), F.col("_k").alias(key), F.col("_leader").alias("leader"))


def gap_items(members: DataFrame, group: str, order: list[str], status: str, missing: Column, sites: Column, most_missing: int = 10) -> DataFrame:
    """For each group its size, worst status and the first distinct missing parts in order."""
    rank = F.when(F.col(status) == "not_found", 2).when(F.col(status) == "partial", 1).otherwise(0)
    counts = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max_by(status, rank).alias("status"))
    # each part once, by its first place, and the first few of a group; no row holds a group's members
    parts = members.select(F.col(group).alias("_g"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], missing.alias("_m"))
    places = parts.select("_g", *[f"_o{i}" for i in range(len(order))], "_m", F.posexplode("_m").alias("_at", "_part")).groupBy("_g", "_part").agg(F.min(F.struct(*[f"_o{i}" for i in range(len(order))], "_m", "_at")).alias("_first"))
    first = places.withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy("_first"))).filter(F.col("_i") <= most_missing)
    lists = first.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_part"))), lambda x: x["_part"]).alias("missing"))
    found = members.select(F.col(group).alias("_g2"), F.explode(sites).alias("_s")).distinct().groupBy("_g2").agg(F.array_sort(F.transform(F.collect_list(F.struct("_s")), lambda x: x["_s"])).alias("sites"))
    out = counts.join(lists, F.col(group).eqNullSafe(F.col("_g")), "left").join(found, F.col(group).eqNullSafe(F.col("_g2")), "left")
    return out.select(group, "n", "status", *[F.coalesce(c, F.array().cast(x.schema[c].dataType)).alias(c) for c, x in (("missing", lists), ("sites", found))])


def nearest_rank(df: DataFrame, by: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """by, and for each name of `shares` the element of the group's sorted values at round(p * (n - 1)), halves to even; nulls do not count.

    Distinct values are counted, dealt by range and written; a group may hold any share of the rows, and what is summed across ranges is one number for a group and range.
    """
    counts = df.groupBy(by, value).agg(F.count(value).alias("_c")).repartitionByRange(by, value).withColumn("_range", F.spark_partition_id())
    path = f"{shared_dir(df.sparkSession)}/ranks-{uuid.uuid4().hex}"
    counts.write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    sums = counts.groupBy(F.col(by).alias("_g"), F.col("_range").alias("_q")).agg(F.sum("_c").alias("_s"))
    whole = Window.partitionBy("_g")
    starts = sums.select("_g", "_q", (F.sum("_s").over(whole.orderBy("_q")) - F.col("_s")).alias("_from"), F.sum("_s").over(whole).alias("_n"))
    end = F.col("_from") + F.sum("_c").over(Window.partitionBy(by, "_range").orderBy(value))
    rows = counts.join(starts, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_q"))).withColumn("_end", end)
    at = {name: F.bround(F.lit(p) * (F.col("_n") - 1), 0).cast("long") for name, p in shares.items()}
    return rows.groupBy(by).agg(*[F.max(F.when((i < F.col("_end")) & (i >= F.col("_end") - F.col("_c")), F.col(value))).alias(name) for name, i in at.items()])


def hits(ranks: DataFrame, rank: str = "rank") -> list[Column]:
    """hit@1, hit@5 and mean reciprocal rank; a null rank is no hit."""
    at = lambda k: F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))).alias(f"hit_{k}")
    return [at(1), at(5), F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))).alias("mrr")]


def first_seen(events: DataFrame, key: str, at: str) -> DataFrame:
    """New visitors by day of their first visit."""
    return events.groupBy(key).agg(F.min(at).alias("_at")).groupBy(F.to_date("_at").alias("day")).agg(F.count(F.lit(1)).alias("visitors"))


def accepted(events: DataFrame, key: str, at: str, ident: str, limit: int, seconds: float) -> DataFrame:
    """Events that a sliding window lets through: at most `limit` accepted ones of a key within `seconds`. Rejected ones do not count.

    Which ones were accepted decides, so a key's events are taken in order; only the last `limit` accepted times are held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        now, recent = None, deque()
        for frame in frames:
            keep = []
            for k, t in zip(frame[key], frame["_t"], strict=True):
                if k != now:
                    now, recent = k, deque()
                while recent and recent[0] <= t - seconds:
                    recent.popleft()
                keep.append(len(recent) < limit)
                if keep[-1]:
                    recent.append(t)
            yield frame.loc[keep, [key, ident]]

    rows = dealt(events.select(key, ident, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_t")), [key], ["_t", ident])
    return rows.mapInPandas(run, f"{key} {events.schema[key].dataType.simpleString()}, {ident} {events.schema[ident].dataType.simpleString()}")


def last_marks(log: DataFrame, query: str, at: str, kind: str, rank: str) -> DataFrame:
    """Marks of a tester: the last one of each query counts. queries, ok, ok share and mean rank of those found."""
    last = log.groupBy(query).agg(F.max_by(F.struct(kind, rank), F.struct(at)).alias("_l")).select("_l.*")
    ok = F.col(kind) == "ok"
    return last.agg(F.count(F.lit(1)).alias("queries"), F.count_if(ok).alias("ok"), F.avg(ok.cast("double")).alias("ok_share"), F.avg(F.when(ok, F.col(rank))).alias("mean_rank"))


def eta(progress: DataFrame, job: str, at: str, percent: str) -> DataFrame:
    """job, at, eta in seconds for every report of a job: a new estimate only when the percent moves, half old and half new; else it counts down.

    A job's reports are folded in order; there are as many as the job made.
    """
    start = F.min(at).over(Window.partitionBy(job))
    packed = progress.withColumn("_s", start).groupBy(job).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("t"), F.col(percent).cast("double").alias("p"), F.col("_s").cast("double").alias("s")))).alias("_r"))
    kind = "array<struct<t:double,eta:double>>"
    zero = F.struct(F.lit(None).cast("double").alias("eta"), F.lit(-1.0).alias("p"), F.lit(0.0).alias("t"), F.array().cast(kind).alias("out"))

    def step(a, x):
        left = F.greatest(F.lit(0.0), a["eta"] - (x["t"] - a["t"]))
        still = a["eta"].isNotNull() & (x["p"] <= a["p"] + 1e-9)
        rate = F.when((x["p"] > 0) & (x["t"] > x["s"]), (100.0 - x["p"]) * (x["t"] - x["s"]) / x["p"])
        moved = F.when(rate.isNotNull() & a["eta"].isNotNull(), 0.5 * rate + 0.5 * left).otherwise(rate)
        now = F.when(still, left).otherwise(moved)
        return F.struct(now.alias("eta"), F.when(still, a["p"]).otherwise(x["p"]).alias("p"), x["t"].alias("t"), F.concat(a["out"], F.array(F.struct(x["t"].alias("t"), now.alias("eta")))).alias("out"))

    folded = F.aggregate("_r", zero, step, lambda a: a["out"])
    return packed.select(job, F.explode(folded).alias("_x")).select(job, F.col("_x.t").alias(at), F.col("_x.eta").alias("eta"))


def low_rated(feedback: DataFrame, most: int, rating: str, updated: str, n: int) -> DataFrame:
    """The worst rated answers, the latest first among equals."""
    return feedback.filter(F.col(rating) <= most).orderBy(rating, F.desc(updated)).limit(n)


def share(flag: Column) -> Column:
    """The share of true values in percent, rounded; nulls count neither way, and without values it is null."""
    return F.round(100 * F.avg(flag.cast("int")), 0).cast("int")


def priced_by_prefix(df: DataFrame, price_list: DataFrame, model: str) -> DataFrame:
    """Rows with the price of the longest listed name that their model begins with, by an equality on prefixes."""
    names = df.select(model).distinct()
    prefixes = names.select(model, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(model))), lambda i: F.substring(F.col(model), F.lit(1), i))).alias("model_name"))
    best = prefixes.join(price_list, "model_name").groupBy(model).agg(F.max_by(F.struct("price_in", "price_out"), F.length("model_name")).alias("_p"))
    return df.join(best, model, "left").select(*df.columns, F.col("_p.price_in").alias("price_in"), F.col("_p.price_out").alias("price_out"))


def known_names(*tables: DataFrame) -> DataFrame:
    """All names of one-column tables, each once."""
    out = tables[0].toDF("name")
    for t in tables[1:]:
        out = out.unionByName(t.toDF("name"))
    return out.filter("name is not null").distinct()


def sorted_heads(decisions: DataFrame) -> DataFrame:
    """head, group: where decisions in batches (batch, n, head, label, known) put the heads of wording groups.

    A label names the group `known`, or where that is null a new one, whose id is the head with the least n of its batch and label. Batches are bounded, so a label's
    rows are few; of a head with several decisions that of the last batch counts.
    """
    named = decisions.groupBy("batch", "label").agg(F.min_by("head", "n").alias("_first"), F.max("known").alias("_known"))
    placed = decisions.join(named, ["batch", "label"]).select("head", "batch", F.coalesce("_known", "_first").alias("group"))
    return placed.groupBy("head").agg(F.max_by("group", "batch").alias("group"))


#: Orders of the list of gaps; the newest question and the group's id break ties.
GAP_ORDERS = {"count": ["count"], "recent": [], "partial": ["partial", "count"], "not_found": ["not_found", "count"]}


def gap_list(rows: DataFrame, groups: DataFrame, order: str = "count", most: int = 50, hidden: bool = False) -> DataFrame:
    """group, count, last_asked, partial, not_found (numbers of such answers) of the first `most` groups of questions without a full answer.

    rows: answer_id, head (of its wording group), created_at, status, hidden, rechecked; groups: as from `sorted_heads`, a head without a decision is its own group. Groups with a hidden member
    are left out unless wanted, and so are those whose last re-check was answered.
    """
    joined = rows.join(groups, "head", "left").withColumn("group", F.coalesce("group", "head"))
    items = joined.groupBy("group").agg(
        F.count(F.lit(1)).alias("count"),
        F.max("created_at").alias("last_asked"),
        F.count_if(F.col("status") == "partial").alias("partial"),
        F.count_if(F.col("status") == "not_found").alias("not_found"),
        F.max(F.coalesce("hidden", F.lit(False))).alias("_hidden"),
        F.max_by("rechecked", F.when(F.col("rechecked").isNotNull(), F.struct("created_at", "answer_id"))).alias("_rechecked"),
    )
    shown = items.filter((F.lit(hidden) | ~F.col("_hidden")) & ~F.col("_rechecked").eqNullSafe("answered")).drop("_hidden", "_rechecked")
    return shown.orderBy(*[F.desc(c) for c in GAP_ORDERS[order]], F.desc("last_asked"), "group").limit(most)
