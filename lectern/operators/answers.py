"""Answers from sources: budgets, citations, event streams of finished answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import dealt


def greedy_budget(df: DataFrame, query: str, order: str, item: str, size: str, most: int) -> DataFrame:
    """Items of each question taken in order while they fit; one that does not is skipped and smaller ones may still fit; the first is always taken.

    What fits depends on what was taken before, so a question's items are streamed in order through one task, which holds the sum so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, taken = object(), 0, 0
        for batch in batches:
            rows, numbers = [], []
            for i, (q, s) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if q != now:
                    now, used, taken = q, 0, 0
                if taken == 0 or (used is not None and s is not None and used + s <= most):
                    used = None if s is None else used + s
                    taken += 1
                    rows.append(i)
                    numbers.append(taken)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(numbers, pa.int32()), kept.column(1), kept.column(2)], [query, "source_no", item, size])

    kind = lambda c: df.schema[c].dataType.simpleString()
    rows = df.select(F.col(query).alias("_q"), F.col(item).alias("_i"), F.col(size).cast("long").alias("_s"), F.col(order).alias("_o"))
    rows = dealt(rows, ["_q"], ["_o", "_i", "_s"])
    return rows.select("_q", "_i", "_s").mapInArrow(run, f"`{query}` {kind(query)}, source_no int, `{item}` {kind(item)}, `{size}` long")


def shown_lines(lines: DataFrame, query: str, source: str, number: str, text: str) -> DataFrame:
    """Lines of sources without those shown in an earlier place or without letters; `ref` names a line."""
    key = F.lower(F.regexp_replace(F.regexp_replace(F.col(text), r"(?U)\s+", " "), "^ | $", ""))
    once = F.row_number().over(Window.partitionBy(query, "_k").orderBy(source, number))
    kept = lines.withColumn("_k", key).filter(F.col("_k").rlike(r"\p{L}")).withColumn("_n", once).filter("_n = 1").drop("_n", "_k")
    return kept.withColumn("ref", F.concat(F.lit("S"), source, F.lit(".L"), number))


def rendered(lines: DataFrame, query: str, source: str, number: str, text: str) -> DataFrame:
    """The prompt text of each source: its lines in order, an ellipsis where lines are left out."""
    gap = F.lag(number).over(Window.partitionBy(query, source).orderBy(number)) != F.col(number) - 1
    line = F.concat(F.when(gap, "…\n").otherwise(""), F.col("ref"), F.lit(": "), F.col(text))
    rows = lines.withColumn("_line", line)
    return rows.groupBy(query, source).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, "_line"))), lambda x: x["_line"]), "\n").alias("prompt"))


def cited(sentences: DataFrame, lines: DataFrame, answer: str = "answer_id") -> DataFrame:
    """answer, sentence, ref, citation: refs of sentences that name a shown line; equal quotes of a site share a number, by first mention.

    sentences: answer, sentence (0-based), refs; lines: answer, ref, quote, site. Sentences without a valid ref drop out.
    """
    refs = sentences.select(answer, "sentence", F.posexplode("refs").alias("_at", "ref")).groupBy(answer, "sentence", "ref").agg(F.min("_at").alias("_at"))
    known = refs.join(lines, [answer, "ref"])
    first = known.groupBy(answer, "quote", "site").agg(F.min(F.struct("sentence", "_at")).alias("_first"))
    numbered = first.withColumn("citation", F.row_number().over(Window.partitionBy(answer).orderBy("_first", "quote", "site")))
    return known.join(numbered.drop("_first"), [answer, "quote", "site"]).select(answer, "sentence", "ref", "citation")


def status(conflict_refs: Column, missing: Column, sentences: Column) -> Column:
    """conflict needs two valid refs; then partial, answered, not_found."""
    return F.when(conflict_refs >= 2, "conflict").when(sentences == 0, "not_found").when(missing > 0, "partial").otherwise("answered")


def events(answers: DataFrame, answer: str, text: str) -> DataFrame:
    """answer, seq, event, delta: a finished answer as the stream that a live one would send, a word at a time and `done` at the end."""
    parts = F.split(F.col(text), "(?<= )")
    deltas = F.concat(F.transform(parts, lambda p: F.struct(F.lit("delta").alias("event"), p.alias("delta"))), F.array(F.struct(F.lit("done").alias("event"), F.lit("").alias("delta"))))
    return answers.select(answer, F.posexplode(deltas).alias("seq", "_e")).select(answer, "seq", "_e.event", "_e.delta")


def reduced(stream: DataFrame, answer: str) -> DataFrame:
    """What a client shows: deltas joined in order, and whether the answer is done."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", "delta")))), lambda x: x["delta"]), "")
    return stream.groupBy(answer).agg(text.alias("text"), F.max((F.col("event") == "done").cast("int")).cast("boolean").alias("done"))


def frame(event: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def navigation_links(links: DataFrame, answer: str, url: str, order: str, n: int = 3) -> DataFrame:
    """The first n distinct addresses of each answer, in order."""
    first = links.groupBy(answer, url).agg(F.min(order).alias(order))
    place = F.row_number().over(Window.partitionBy(answer).orderBy(order, url))
    return first.withColumn("place", place).filter(F.col("place") <= n)


def focus(citations: DataFrame, answer: str, kind: str, order: str, item: str) -> DataFrame:
    """The citation to open first: the first of a file, else the first."""
    return citations.groupBy(answer).agg(F.min_by(item, F.struct((F.col(kind) != "file").alias("k"), order)).alias(item))


def untranslated(citations: DataFrame, lang: Column) -> DataFrame:
    """Quotes in another language than the answer's that have no translation yet, each text once."""
    return citations.filter((F.col("quote_lang") != lang) & (F.coalesce("translation", F.lit("")) == "")).select("quote", "quote_lang").distinct()


def verified_contacts(found: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Contacts that the cited lines bear out: a phone by its digits (five or more), an e-mail by its text; others drop out.

    found: key, phone, email; lines: key, texts (array).
    """
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    joined = found.join(lines, key)
    phone = (F.length(digits(F.col("phone"))) >= 5) & F.exists("texts", lambda t: F.contains(digits(t), digits(F.col("phone"))))
    email = F.exists("texts", lambda t: F.contains(F.lower(t), F.lower("email")))
    ok = joined.withColumns({"phone": F.when(phone, F.col("phone")), "email": F.when(email, F.col("email"))})
    return ok.filter("phone is not null or email is not null").drop("texts")


def needs_rewrite(lang: Column, turns_before: Column) -> Column:
    """A question in another language than the corpus, or one within a conversation, is asked anew before the search."""
    return (lang != "ro") | (turns_before > 0)


def needs_second_pass(verdict: Column, conflict: Column) -> Column:
    """A partial answer, or one with a conflict unless it was refused, is worth a second search."""
    return (verdict == "partial") | ((verdict != "refused") & conflict)


def good_answer(status_: Column, verified: Column, citations: Column) -> Column:
    """Answered, verified and with a citation."""
    return (status_ == "answered") & verified & (citations > 0)


def parsed_frames(text: Column) -> Column:
    """array<struct<event,data>> of a text of server-sent events; lines of data are joined, a frame without an event is a message, other fields are left out."""
    lines = lambda f, name: F.transform(F.filter(F.split(f, r"\r?\n"), lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    frames = F.filter(F.split(text, r"\r?\n\r?\n"), lambda f: f != "")
    return F.filter(F.transform(frames, lambda f: F.struct(F.coalesce(F.get(F.reverse(lines(f, "event")), 0), F.lit("message")).alias("event"), F.array_join(lines(f, "data"), "\n").alias("data"))), lambda x: (x["data"] != "") | (x["event"] != "message"))


def trimmed(items: Column, most: int) -> Column:
    """struct<items,truncated>: the leading elements whose JSON array has at most `most` characters, and whether any were dropped.

    The length of the array is the sum of its elements' and the marks between.
    """
    sizes = F.transform(items, lambda x: F.length(F.to_json(F.struct(x.alias("x")))) - 6 + 1)  # without {"x":}, with a comma
    fits = F.aggregate(sizes, F.struct(F.lit(1).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, s: F.struct((a["used"] + s).alias("used"), F.when(a["open"] & (a["used"] + s <= most), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["open"] & (a["used"] + s <= most)).alias("open")), lambda a: a["n"])
    return F.struct(F.slice(items, F.lit(1), fits).alias("items"), (fits < F.size(items)).alias("truncated"))


def focused(exact: DataFrame, matched: DataFrame, chunk: str, line: str, order: str) -> DataFrame:
    """chunk, lines: the lines to show of each chunk, those found word for word before those that a search matched, a line once."""
    both = exact.select(chunk, line, order, F.lit(0).alias("_s")).unionByName(matched.select(chunk, line, order, F.lit(1).alias("_s")))
    first = both.groupBy(chunk, line).agg(F.min(F.struct("_s", order)).alias("_at"))
    return first.groupBy(chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", line))), lambda x: x[line]).alias("lines"))


def unused(retrieved: Column, cited_: Column) -> Column:
    """Sites that a search found and the answer does not cite, each once."""
    return F.array_sort(F.array_except(F.array_distinct(retrieved), cited_))


def with_contacts(text: Column, status_: Column, names: Column, not_found: Column, partial: Column) -> Column:
    """An answer that ends with the contacts that can help; one that was not found becomes a sentence about them. `{names}` stands for the names."""
    filled = lambda t: F.replace(t, F.lit("{names}"), F.array_join(names, ", "))
    return F.when(F.size(names) == 0, text).when(status_ == "not_found", filled(not_found)).when(status_ == "partial", F.concat_ws(" ", text, filled(partial))).otherwise(text)


def gap_facts(answers: DataFrame, answer: str, asked: str, status_: str, missing: str, sites: str) -> DataFrame:
    """What answers leave open: a row for each partial or missing answer, with its missing parts and sites as stable JSON."""
    return answers.filter(F.col(status_).isin("partial", "not_found")).select(answer, asked, F.col(status_).alias("status"), F.to_json(F.array_distinct(missing)).alias("missing"), F.to_json(F.array_sort(F.array_distinct(sites))).alias("sites"))


def windows(lines: DataFrame, hits: DataFrame, source: str, number: str, place: str, most: int = 2, wide: int = 5, narrow: int = 2, first: int = 4) -> DataFrame:
    """Lines of each source around its best `most` hits: `wide` lines about them in the first sources, `narrow` in the others; a source without hits shows its beginning.

    lines: source, number (from 1), place (of the source, from 1); hits: source, number, rank.
    """
    best = hits.withColumn("_p", F.row_number().over(Window.partitionBy(source).orderBy("rank", number))).filter(F.col("_p") <= most).select(source, F.col(number).alias("_hit"))
    near = best.groupBy(source).agg(F.collect_list("_hit").alias("_hits"))  # at most `most` numbers
    radius = F.when(F.col(place) <= first, wide).otherwise(narrow)
    known = F.coalesce("_hits", F.array(F.lit(1).cast(lines.schema[number].dataType)))
    return lines.join(near, source, "left").filter(F.exists(known, lambda h: F.abs(F.col(number) - h) <= radius)).drop("_hits")
