"""Reports over events, labels, conversations and orders, which stand in for usage, feedback and question logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import texts
from lectern.operators import analytics, ranking
from lectern.registry import query
from lectern.session import table

PRICES = {"view": (0.15, 0.6), "view-2024": (0.3, 1.2), "click": (2.5, 10.0), "purchase": (3.0, 15.0)}
_PRICE_ROWS = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in PRICES.items())
TODAY = "2024-01-25"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    model = F.concat("event_type", F.get(F.array(*map(F.lit, ["", "-2024-05", ":free", "x"])), (F.col("event_id") % 4).cast("int")))
    tokens = F.floor(F.abs("value") * 100).cast("long")
    return e.select("event_id", "ts", analytics.local_day(F.col("ts")).alias("day"), model.alias("model"), F.col("event_type").alias("kind"), tokens.alias("input_tokens"), (F.col("event_id") % 50).cast("long").alias("output_tokens"))


_CALLS = """calls AS (
  SELECT event_id, CAST(timezone('Europe/Chisinau', timezone('UTC', ts)) AS DATE) AS day, event_type || ['', '-2024-05', ':free', 'x'][(event_id % 4 + 1)::INT] AS model, event_type AS kind,
         floor(abs(value) * 100)::BIGINT AS input_tokens, (event_id % 50)::BIGINT AS output_tokens FROM events
)"""
_PRICED = f"""{_CALLS}, prices(name, pin, pout) AS (VALUES {_PRICE_ROWS}),
priced AS (SELECT c.*, (SELECT arg_max(pin, length(name)) FROM prices WHERE c.model = name OR starts_with(c.model, name || '-') OR starts_with(c.model, name || ':')) AS pin,
  (SELECT arg_max(pout, length(name)) FROM prices WHERE c.model = name OR starts_with(c.model, name || '-') OR starts_with(c.model, name || ':')) AS pout FROM calls c),
g AS (SELECT day, model, kind, count(*) AS calls, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o, any_value(pin) AS pin, any_value(pout) AS pout FROM priced GROUP BY day, model, kind),
t AS (SELECT *, (i * pin + o * pout) / 1000000 AS cost FROM g)"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = analytics.usage_groups(_calls(spark, sf_dir), ["day", "model", "kind"])
    found = analytics.priced(groups, analytics.prices(spark, PRICES), "model")
    return found.withColumn("cost", analytics.cost(F.col("price_in"), F.col("price_out"), F.col("input_tokens"), F.col("output_tokens")))


@query(f"WITH {_CALLS} SELECT day, model, kind, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM calls GROUP BY ALL")
def usage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.usage_groups(_calls(spark, sf_dir), ["day", "model", "kind"])


@query(f"WITH {_PRICED} SELECT DISTINCT model, pin AS price_in, pout AS price_out FROM t")
def price_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _calls(spark, sf_dir).select("model").distinct()
    return analytics.priced(models, analytics.prices(spark, PRICES), "model")


@query(f"""
WITH {_PRICED}, d AS (SELECT unnest(generate_series(DATE '{TODAY}' - 13, DATE '{TODAY}', INTERVAL 1 DAY))::DATE AS day)
SELECT d.day, coalesce(sum(calls), 0)::BIGINT AS calls, round(coalesce(sum(coalesce(cost, 0)), 0), 9) AS cost FROM d LEFT JOIN t USING (day) GROUP BY d.day
""")
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily(_priced(spark, sf_dir), F.lit(TODAY).cast("date"), 14).withColumn("cost", F.round("cost", 9))


@query(f"WITH {_PRICED} SELECT kind, sum(calls)::BIGINT AS calls, sum(i)::BIGINT AS input_tokens, round(sum(coalesce(cost, 0)), 9) AS cost FROM t GROUP BY kind")
def usage_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).groupBy("kind").agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 9).alias("cost"))


@query(f"WITH {_PRICED} SELECT model, sum(calls)::BIGINT AS calls, round(sum(cost), 9) AS cost, row_number() OVER (ORDER BY round(coalesce(sum(cost), 0), 9) DESC, sum(i + o) DESC, model)::INT AS place FROM t GROUP BY model")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _priced(spark, sf_dir).groupBy("model").agg(F.sum("calls").alias("calls"), F.round(F.sum("cost"), 9).alias("cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("_t"))
    # one row a model: a short list
    order = Window.orderBy(F.desc(F.coalesce("cost", F.lit(0.0))), F.desc("_t"), "model")
    return m.withColumn("place", F.row_number().over(order)).drop("_t")


@query(f"""
WITH {_PRICED}, r AS (SELECT DATE '{TODAY}' AS today)
SELECT {", ".join(f"coalesce(sum(calls) FILTER ({c}), 0)::BIGINT AS {n}_calls, round(coalesce(sum(cost) FILTER ({c}), 0), 9) AS {n}_cost, coalesce(sum(calls) FILTER ({c} AND cost IS NULL), 0)::BIGINT AS {n}_unpriced" for n, c in (("today", "day = today"), ("month", "day >= date_trunc('month', today)"), ("range", "day > today - 7"), ("all", "true")))},
  round(coalesce(sum(cost) FILTER (day >= date_trunc('month', today)), 0) / 25 * 31, 8) AS month_forecast FROM t, r
""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = analytics.totals(_priced(spark, sf_dir), F.lit(TODAY).cast("date"), 7)
    return row.select(*[F.round(c, 8 if c == "month_forecast" else 9).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


@query("SELECT v.q AS quality, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 6))::INT AS q) v LEFT JOIN (SELECT quality, count(*) AS n FROM labels GROUP BY quality) l ON l.quality = v.q")
def zero_filled_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.histogram(table(spark, sf_dir, "labels"), "quality", 0, 5)


@query("SELECT k::VARCHAR AS tag, count(*) AS n FROM (SELECT (props::JSON->>'$.k') AS k FROM events) GROUP BY 1 ORDER BY n DESC, tag LIMIT 6")
def json_props_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_tags(table(spark, sf_dir, "events"), F.array(F.get_json_object("props", "$.k")), 6)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 9) AS average FROM events GROUP BY 1")
def feedback_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("average"))


@query("SELECT user_id, event_type, value, ts, created_at FROM (SELECT user_id, event_type, value, ts, min(ts) OVER (PARTITION BY user_id, event_type) AS created_at, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS n FROM events) WHERE n = 1")
def latest_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest_ratings(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value")


@query("SELECT source, lang, hits, place FROM (SELECT source, lang, count(*) AS hits, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang)::INT AS place FROM documents GROUP BY source, lang) WHERE place <= 3")
def top_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_per_group(table(spark, sf_dir, "documents"), "source", "lang", 3)


@query("SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS p FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)) WHERE p = 1")
def most_common_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.most_common(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


_QUESTIONS = r"""q AS (
  SELECT conv_id, turn, text, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), '[?!. ]+$', '')), '', ''), '', '') AS k, conv_id % 3 AS lang FROM conversations WHERE role = 'user'
),
a AS (SELECT q.*, quality IS DISTINCT FROM 0 AS good, quality * 4 + 1 AS rating FROM q LEFT JOIN labels l ON l.doc_id = q.conv_id)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("lang", F.col("conv_id") % 3)
    joined = asked.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "conv_id"), "conv_id", "left")
    rows = joined.withColumns({"good": ~F.col("quality").eqNullSafe(0), "rating": F.col("quality") * 4 + 1})
    return analytics.question_candidates(rows, "lang", texts.question_key(F.col("text")), "text", "good", "rating", "conv_id", "turn")


@query(f"WITH {_QUESTIONS} SELECT lang, min(text) AS question, count(*) AS asked_count, bool_and(good) AS always_good, avg(rating)::DOUBLE AS rating_avg, min(rating)::INT AS rating_min, arg_max(conv_id, (turn, conv_id)) AS answer_id FROM a GROUP BY lang, k")
def suggestion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


@query(f"""
WITH {_QUESTIONS}, c AS (SELECT lang, min(text) AS question, count(*) AS asked_count, bool_and(good) AS always_good, avg(rating)::DOUBLE AS rating_avg, min(rating)::INT AS rating_min, arg_max(conv_id, (turn, conv_id)) AS answer_id FROM a GROUP BY lang, k)
SELECT lang, question, asked_count, answer_id FROM c WHERE always_good AND length(trim(question)) BETWEEN 10 AND 120 AND (rating_min IS NULL OR rating_min > 2) AND (rating_avg IS NULL OR rating_avg >= 4) AND asked_count >= 1 AND NOT regexp_matches(question, '\\d[\\d\\s().-]{{5,}}\\d|@')
""")
def suggested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.chosen(_candidates(spark, sf_dir), texts.qualifies(F.col("question")), 1)
    return found.select("lang", "question", "asked_count", "answer_id")


@query("""
SELECT conv_id, turn, CASE WHEN length(text) < 80 AND before IS NOT NULL THEN substr(before, 1, 300) || ' ' || text ELSE text END AS query FROM (
  SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
""")
def followup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    joined = F.concat(F.substring(before, 1, 300), F.lit(" "), F.col("text"))
    return asked.select("conv_id", "turn", F.when((F.length("text") < 80) & before.isNotNull(), joined).otherwise(F.col("text")).alias("query"))


@query("""
SELECT conv_id, turn, coalesce(array_to_string(list_transform(list((role, substr(text, 1, 300))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), lambda x: x[1] || ': ' || x[2]), chr(10)), '') AS context FROM conversations
""")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four turns before each turn, each cut to 300 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    said = F.collect_list(F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 300))).over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(said, "\n").alias("context"))


@query("""
WITH RECURSIVE e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
r(label, i, vec_id, leader, heads) AS (
  SELECT label, i, vec_id, vec_id, [{'id': vec_id, 'v': v}] FROM e WHERE i = 1
  UNION ALL SELECT label, i, vec_id, coalesce(near, vec_id), CASE WHEN near IS NULL THEN list_append(heads, {'id': vec_id, 'v': v}) ELSE heads END
  FROM (SELECT e.label, e.i, e.vec_id, e.v, r.heads, list_filter(r.heads, lambda h: list_dot_product(h.v, e.v) >= 0.6)[1].id AS near FROM r JOIN e ON e.label = r.label AND e.i = r.i + 1)
)
SELECT label, vec_id, leader FROM r
""")
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy leaders by label, oldest first."""
    return analytics.leaders(table(spark, sf_dir, "embeddings"), "label", ["vec_id"], "vec_id", "embedding", 0.6)


@query("""
WITH r AS (SELECT p.vec_id AS probe, e.vec_id, e.label = p.label AS same, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank FROM embeddings e, embeddings p WHERE p.vec_id % 20 = 0 AND e.vec_id % 20 <> 0),
f AS (SELECT probe, min(rank) FILTER (same AND rank <= 10) AS rank FROM r GROUP BY probe)
SELECT probe % 3 AS pair, count(*) AS n, round(avg(coalesce((rank <= 1)::INT, 0)), 9) AS hit_1, round(avg(coalesce((rank <= 5)::INT, 0)), 9) AS hit_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr FROM f GROUP BY 1
""")
def eval_hits_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding")
    near = ranking.batch_topk(probes, v.filter("vec_id % 20 <> 0"), 10).join(v.select("vec_id", "label"), "vec_id")
    own = v.select(F.col("vec_id").alias("probe"), F.col("label").alias("own"))
    first = near.join(own, "probe").filter("label = own").groupBy("probe").agg(F.min("rank").alias("rank"))
    all_ = probes.select("probe").join(first, "probe", "left").groupBy((F.col("probe") % 3).alias("pair")).agg(F.count(F.lit(1)).alias("n"), *analytics.hits(first))
    return all_.select("pair", "n", *[F.round(c, 9).alias(c) for c in ("hit_1", "hit_5", "mrr")])


@query("""
WITH o AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type)
SELECT event_type, v[(round_even(0.5 * (len(v) - 1), 0) + 1)::INT] AS p50, v[(round_even(0.95 * (len(v) - 1), 0) + 1)::INT] AS p95 FROM o
""")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT day, count(*) AS visitors FROM (SELECT user_id, min(ts)::DATE AS day FROM events GROUP BY user_id) GROUP BY day")
def unique_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.first_seen(table(spark, sf_dir, "events"), "user_id", "ts")


#: Accepted events by recursion: after an accepted event, the times of the last three accepted ones decide about the next.
RATE_LIMITED = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(user_id, i, event_id, recent, ok) AS (
  SELECT user_id, i, event_id, [t], true FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN len(list_filter(r.recent, lambda x: x > e.t - 21600000000)) < 3 THEN list_append(list_filter(r.recent, lambda x: x > e.t - 21600000000), e.t) ELSE r.recent END,
    len(list_filter(r.recent, lambda x: x > e.t - 21600000000)) < 3 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
)
SELECT user_id, event_id FROM r WHERE ok
"""


@query(RATE_LIMITED)
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.accepted(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 21600)


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(event_id % 10, (ts, event_id)) AS rank FROM events GROUP BY user_id)
SELECT count(*) AS queries, count(*) FILTER (kind = 'purchase') AS ok, round(avg((kind = 'purchase')::INT), 9) AS ok_share, round(avg(rank) FILTER (kind = 'purchase'), 9) AS mean_rank FROM l
""")
def tester_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", "ok").otherwise(F.col("event_type")).alias("kind"), (F.col("event_id") % 10).alias("rank"))
    row = analytics.last_marks(log, "user_id", "at", "kind", "rank")
    return row.select("queries", "ok", F.round("ok_share", 9).alias("ok_share"), F.round("mean_rank", 9).alias("mean_rank"))


@query("""
WITH r AS (SELECT source, (n_chars % 3)::INT AS k, doc_id, lang FROM documents)
SELECT source, count(*) AS n, CASE max(CASE k WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END) WHEN 2 THEN 'not_found' WHEN 1 THEN 'partial' ELSE 'answered' END AS status,
  array_to_string(list_distinct(list(lang)).list_sort(), ',') AS langs FROM r GROUP BY source
""")
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_chars") % 3
    rows = table(spark, sf_dir, "documents").withColumn("status", F.when(k == 2, "not_found").when(k == 1, "partial").otherwise("answered"))
    out = analytics.gap_items(rows, "source", ["doc_id"], "status", F.array("lang"), F.array("lang"))
    return out.select("source", "n", "status", F.array_join("sites", ",").alias("langs"))


@query("SELECT n_name, count(c_custkey) AS customers, count(*) FILTER (c_acctbal < 0) AS in_debt, count(DISTINCT c_mktsegment) FILTER (c_acctbal > 5000) AS rich_segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.countDistinct(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))).alias("rich_segments"))


@query("SELECT max(ts)::VARCHAR || '/' || count(*) AS version FROM events")
def index_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.concat(F.max("ts").cast("string"), F.lit("/"), F.count(F.lit(1))).alias("version"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':7'), doc_id) AS n FROM documents) WHERE n <= 10")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 10, "doc_id", 7)


@query(r"""
WITH t AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT doc_id, count(*) AS n FROM t WHERE length(line) BETWEEN 50 AND 320 AND NOT regexp_matches(line, '(?i)^(pagin[aă]|pagina|anexa|articolul|capitolul|data|nr\.)') AND NOT regexp_matches(line, '^[0-9\.\-\s:,]+$') GROUP BY doc_id
""".replace("\\\\", "\\"))
def eval_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document can be asked about."""
    from lectern.functions.questions import asks_well
    from lectern.operators.corpus import lines

    return lines(table(spark, sf_dir, "documents")).filter(asks_well(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, value FROM events WHERE value <= 3 ORDER BY value, ts DESC, event_id LIMIT 25")
def low_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("_u", F.struct("ts", (-F.col("event_id")).alias("i")))
    return analytics.low_rated(e, 3, "value", "_u", 25).select("user_id", "event_id", "value")


@query("""
WITH RECURSIVE o AS (SELECT o_custkey, floor(epoch(o_orderdate))::BIGINT AS t0, o_orderkey, 100.0::DOUBLE * row_number() OVER w / count(*) OVER (PARTITION BY o_custkey) AS percent, min(floor(epoch(o_orderdate))::BIGINT) OVER (PARTITION BY o_custkey) AS began,
  row_number() OVER w AS i FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r(o_custkey, i, t0, p, eta) AS (
  SELECT o_custkey, i, t0, percent, NULL::DOUBLE FROM o WHERE i = 1
  UNION ALL SELECT o.o_custkey, o.i, o.t0, o.percent, CASE WHEN o.t0 > o.began THEN CASE WHEN r.eta IS NULL THEN (100.0::DOUBLE - o.percent) * (o.t0 - o.began) / o.percent
    ELSE 0.5::DOUBLE * ((100.0::DOUBLE - o.percent) * (o.t0 - o.began) / o.percent) + 0.5::DOUBLE * greatest(0.0::DOUBLE, r.eta - (o.t0 - r.t0)) END END
  FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1
)
SELECT o_custkey, t0 AS "at", round(eta, 4) AS eta FROM r
""")
def job_etas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as reports of a job, its lines as progress."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    n = F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))
    done = F.row_number().over(Window.partitionBy("o_custkey").orderBy("at", "o_orderkey"))
    out = analytics.eta(orders.select("o_custkey", "at", (100.0 * done / n).alias("percent")), "o_custkey", "at", "percent")
    return out.select("o_custkey", F.col("at").cast("long").alias("at"), F.round("eta", 4).alias("eta"))
