"""Contact cards from lines of web pages: phones, e-mails, names, addresses and hours, one card for each set of contacts of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.texts import emails, phones

# Words that begin the name of an institution, words that join its parts, and patterns of lines.
INSTITUTIONS = (
    r"Direcți[ae]|Directia|Serviciul|Pretura|Primăria|Primaria|Consiliul|Întreprinderea|Intreprinderea|Regia|Centrul|Agenția|Departamentul|Secția|Inspecția|Biroul|Instituția|Parcul|Asociația|Î\.M\."
    r"|Дирекция|Главное управление|Управление|Служба|Претура|Примэрия|Мэрия"
)
CONNECTORS = "și|si|de|a|al|ai|pentru|din|la|în|municipiului|orașului|mun\\.|и|по|города|муниципия"
ADDRESS = r"(?iuU)(\bMD-?\s?\d{4}\b|\bstr(?:ada|\.)\s|\bbd\.|\bbulevardul\b|\bул\.|\bбул\.)"
HOURS = r"(?iuU)\b(luni|marți|marti|vineri|program|orele|понедельник|пятниц|график|часы)\b.*\d{1,2}[:.]\d{2}"
CONTACT_PAGE = r"(?iu)contact|audien|despre|about|контакт"
_NAME = r"[„\"«]?[A-ZĂÂÎȘȚА-ЯЁ][\w.\-]*[”\"»]?,?"
INSTITUTION = rf"(?U)\b(?:{INSTITUTIONS})(?:\s+(?:{_NAME}(?=\s|$)|(?i:{CONNECTORS})(?=\s+{_NAME}(?:\s|$))))+"


def institution(text: Column) -> Column:
    """The name of an institution in a text: a word for one and the capitalised words after it."""
    name = F.regexp_replace(F.regexp_extract(text, INSTITUTION, 0), r"[,. ]+$", "")
    return F.nullif(F.substring(name, 1, 120), F.lit(""))


def _first(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), 0)


def cards(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """A card for each chunk with a phone or an e-mail.

    chunks: chunk_id, site, url, title; lines: chunk_id, idx, line_id, line. The name stands on the phone's line or up to two lines above, else on
    any line, else it is the title or the site. A chunk's lines are packed into one row.
    """
    found = lines.select("chunk_id", "idx", "line_id", "line", phones(F.col("line")).alias("phones"), emails(F.lower("line")).alias("emails"), institution(F.col("line")).alias("name"))
    row = F.struct("idx", "line_id", "line", "phones", "emails", "name")
    packed = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list(row)).alias("ls"), F.max(F.size("phones") + F.size("emails")).alias("_n")).filter("_n > 0")
    has = lambda x: F.size(x["phones"]) + F.size(x["emails"]) > 0
    near = F.flatten(F.transform(F.filter("ls", has), lambda x: F.array(x["name"], *[F.get(F.filter("ls", lambda y, d=d: y["idx"] == x["idx"] - d), 0)["name"] for d in (2, 1)])))
    line_of = lambda p: F.get(F.filter("ls", lambda x: x["line"].rlike(p)), 0)
    address, hours = line_of(ADDRESS), line_of(HOURS)
    sentence = F.get(F.filter(F.split(hours["line"], r"(?U)(?<=[.!?])\s+"), lambda s: s.rlike(HOURS)), 0)
    rows = packed.join(chunks, "chunk_id")
    name = F.coalesce(_first(near), _first(F.transform("ls", lambda x: x["name"])), F.nullif(F.col("title"), F.lit("")), F.col("site"))
    every = lambda c: F.array_distinct(F.flatten(F.transform("ls", lambda x: x[c])))
    used = F.concat(F.transform(F.filter("ls", has), lambda x: x["line_id"]), F.filter(F.array(address["line_id"], hours["line_id"]), lambda i: i.isNotNull()))
    out = rows.select("site", "url", name.alias("name"), every("phones").alias("phone"), every("emails").alias("email"), F.substring(address["line"], 1, 200).alias("address"), F.substring(sentence, 1, 200).alias("hours"), F.array_distinct(used).alias("line_ids"))
    key = F.concat_ws("|", "site", F.array_join(F.array_sort("phone"), "|"), F.array_join(F.array_sort("email"), "|"))
    return out.withColumn("contact_id", F.substring(F.sha1(key), 1, 16))


def deduplicated(found: DataFrame) -> DataFrame:
    """One card an id: from a contact page first, then from the shortest address. A grouped minimum."""
    columns = [c for c in found.columns if c != "contact_id"]
    order = F.struct((~F.col("url").rlike(CONTACT_PAGE)).alias("p"), F.length("url").alias("n"), F.col("url").alias("u"), F.array_join("line_ids", ",").alias("l"))
    return found.groupBy("contact_id").agg(F.min_by(F.struct(*columns), order).alias("_c")).select("contact_id", "_c.*")


#: Fixed value: what the names of a whole city's pages say in general.
GENERAL = r"(?iuU)\b(Primăria|Primaria)( municipiului)? Chișinău|\bПримэри[яи]|\bМэри[яи] Кишин"


def embed_text(name: Column, area: Column, about: Column) -> Column:
    """What a card is found by: its name, area and description, without what many cards say."""
    parts = [F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), GENERAL, ""), r"^[ .:|-]+|[ .:|-]+$", "") for c in (name, area, about)]
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ". ")


def picked(near: DataFrame, general: DataFrame, question: str, card: str, score: str, least: float, most: int = 2) -> DataFrame:
    """The best `most` cards of each question at or above `least`; a question without any gets the general card (one row or none)."""
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc(score), card))
    good = near.filter(F.col(score) >= least).withColumn("place", place).filter(F.col("place") <= most).select(question, card, "place")
    rest = near.select(question).distinct().join(good.select(question).distinct(), question, "left_anti")
    one = general.select(card).limit(1).withColumn("place", F.lit(1))
    return good.unionByName(rest.withColumn("place", F.lit(1)).join(F.broadcast(one), "place").select(question, card, "place"))
