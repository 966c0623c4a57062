"""What a document says about itself: title, own heading lines, act type, number and date, from its first blocks and the links to it.

Every choice is a grouped minimum or maximum over blocks or links, so no document is packed into a row; only the few lines of a title block are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import acts
from lectern.functions.urls import part

HEAD_BLOCKS, TITLE_CHARS, LEAST_TITLE, SHORT_LINE = 12, 300, 8, 40

# Lines of a letterhead, subject lines, first lines of a body, short lines that belong to a title.
LETTERHEAD = r"(?iuU)^(republica moldova|prim[aă]r|consiliul municipal|республика молдова|примар|муниципальный совет)"
SUBJECT = r"(?iuU)^(cu privire la|privind|despre|об|о)\s"
SUBJECT_INSIDE = r"(?iuU)\b(?:cu privire la|privind|despre)\b"
BODY = (
    r"(?iuU)^(?:(?:cu privire la|privind|despre|об|о|având|avînd|în temeiul|in temeiul|în scopul|în conformitate|"
    r"în baza|prezentul|articolul|capitolul|на основании|в соответствии|статья|глава)\b|art\.|\d+\.\s)"
)
OWN_LINE = r"(?iuU)^\W*(nr\b|n\.|№|din\b|от\b)"
ACT_LINE = r"(?iuU)^\W*(?:" + "|".join(acts.ACT_TYPES.values()) + r")\b"


def file_name(url: Column) -> Column:
    """The last element of an address's path, decoded, without its extension."""
    name = F.regexp_extract(part(url, "path"), "([^/]*)$", 1)
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name), r"(?U)\.\w+$", "")


def link_texts(sources: DataFrame, by: str, order: str, url: str = "url", anchor: str = "anchor") -> DataFrame:
    """by, files, anchors (texts of all links in order, with bars between), longest (the longest link text, the first of equals)."""
    named = sources.select(by, order, F.nullif(file_name(F.col(url)), F.lit("")).alias("_f"), F.nullif(F.col(anchor), F.lit("")).alias("_a"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda x: x[c]), " | ")
    return named.groupBy(by).agg(joined("_f").alias("files"), joined("_a").alias("anchors"), F.max_by("_a", F.struct(F.length("_a").alias("n"), (-F.col(order)).alias("o"))).alias("longest"))


def heads(blocks: DataFrame, by: str = "doc_id", order: str = "id") -> DataFrame:
    """by, subject, heading, any_heading, headings, own: the subject line and headings of the first blocks, the first fit heading of all blocks, and the
    document's own heading lines, up to the subject or the body. `order` counts from 0."""
    at, text = F.col(order), F.col("text")
    head, heading = at < HEAD_BLOCKS, F.col("type") == "heading"
    fit = heading & (F.length(text) >= LEAST_TITLE) & ~text.rlike(LETTERHEAD)
    first = lambda cond: F.min_by(F.when(cond, text), F.when(cond, at))
    trimmed = F.trim(text)
    own = F.when(trimmed.rlike(ACT_LINE), F.get(F.split(trimmed, SUBJECT_INSIDE, 2), 0)).when((F.length(trimmed) <= SHORT_LINE) & trimmed.rlike(OWN_LINE), trimmed)
    listed = lambda cond, c: F.array_sort(F.collect_list(F.when(cond, F.struct(at.alias("i"), c.alias("t")))))
    shown = lambda rows: F.array_join(F.transform(rows, lambda x: x["t"]), "\n")
    found = blocks.withColumn("_own", F.when(head, own)).groupBy(by).agg(
        F.substring(first(head & text.rlike(SUBJECT)), 1, TITLE_CHARS).alias("subject"),
        first(fit).alias("heading"),
        first(heading).alias("any_heading"),
        listed(head & heading, text).alias("_headings"),
        listed(F.col("_own").isNotNull(), F.col("_own")).alias("_own"),
        F.min(F.when(head & trimmed.rlike(BODY), at)).alias("_body"),
    )
    above = F.filter("_own", lambda x: F.col("_body").isNull() | (x["i"] < F.col("_body")))
    return found.select(by, "subject", "heading", "any_heading", shown(F.col("_headings")).alias("headings"), shown(above).alias("own"))


def described(blocks: DataFrame, sources: DataFrame, by: str = "doc_id", order: str = "id", link_order: str = "place") -> DataFrame:
    """by, title, doc_type, number, date of every document with blocks.

    The type comes from headings, else own lines, else link texts, else file names; number and date only for acts. Link texts say less than the document itself.
    """
    both = heads(blocks, by, order).join(link_texts(sources, by, link_order), by, "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.coalesce(*[acts.act_type(text(c)) for c in ("headings", "own", "anchors", "files")])
    found = both.select(by, F.coalesce("subject", "heading", "longest", "any_heading").alias("title"), kind.alias("doc_type"), "files", "own", "anchors")
    number = F.coalesce(acts.reconciled_number(text("files"), text("own")), F.get(acts.act_numbers(text("anchors")), 0))
    date = F.coalesce(*[acts.act_date(text(c)) for c in ("own", "files", "anchors")])
    act = F.col("doc_type").isNotNull()
    return found.select(by, "title", "doc_type", F.when(act, number).alias("number"), F.when(act, date).alias("date"))
