"""Expressions for official acts: type, numbers, dates, legal items, numbers of claims."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import let
from lectern.functions.texts import folded, words

# Types of acts, months, legal items.
ACT_TYPES = {
    "decizie": "decizi[ae]|решени[ея]",
    "dispozitie": "dispozi[țt]i[ae]|распоряжени[ея]",
    "hotarare": "hot[ăa]r[âa]re[a]?|постановлени[ея]",
    "regulament": "regulament(?:ul)?|положени[ея]",
    "ordin": "ordin(?:ul)?|приказ",
    "lege": "lege[a]?|закон",
    "proces-verbal": "proces(?:ul)?[- ]verbal|протокол",
    "anunt": "anun[țt](?:ul)?|объявлени[ея]",
}
ACT_BEGINS = "".join(sorted({p[0] for ps in ACT_TYPES.values() for p in ps.split("|")}))
MONTHS_RO = "ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie".split()
MONTHS_RU = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
NUMBER = (
    r"(?iuU)(?:\bnr\.?|\bn\.(?=\s*\d)|№|\b(?:decizi[ae]|dispozi[țt]i[ae]|hot[ăa]r[âa]re[a]?|ordin(?:ul)?))[\s_.-]*"
    r"(?:nr\.?[\s_-]*)?(\d+(?:[/.-]\d+)*(?:\s*-\s*(?!din\b)[a-zA-Zа-яА-Я]{1,3}\b)?)"
)
_REFERENCE = r"(?!\s+(?:din\s+(?:legea|codul|hot[ăa]r|decizi|ordin)|al\s+legii|закона|кодекса|постановления|решения))"
#: level, pattern, label of each kind of legal item, by language as their labels differ, tried in this order; {n} is the first group that took part.
LEGAL_ITEMS = [
    (0, r"^\s*anexa\b(?:\s+(?:nr\.?|n\.|№))?\s*([0-9]+[a-zA-Zа-яА-Я0-9/.-]*)?", "Anexa nr. {n}", "Anexa"),
    (0, r"^\s*приложение\b(?:\s+(?:nr\.?|n\.|№))?\s*([0-9]+[a-zA-Zа-яА-Я0-9/.-]*)?", "Приложение № {n}", "Приложение"),
    (1, r"^\s*capitolul\s+([IVXLCDM]+|[0-9]+)\b", "Capitolul {n}", None),
    (1, r"^\s*глава\s+([IVXLCDM]+|[0-9]+)\b", "Глава {n}", None),
    (2, r"^\s*sec[țt]iunea\s+(?:(?:nr\.?|№)\s*)?([IVXLCDM]+|[0-9]+)\b", "Secțiunea {n}", None),
    (2, r"^\s*раздел\s+(?:(?:nr\.?|№)\s*)?([IVXLCDM]+|[0-9]+)\b", "Раздел {n}", None),
    (3, rf"^\s*articolul\s*([0-9]+(?:[-/][0-9]+)*){_REFERENCE}\b", "Articolul {n}", None),
    (3, rf"^\s*art\.\s*([0-9]+(?:[-/][0-9]+)*){_REFERENCE}\b", "Art. {n}", None),
    (3, rf"^\s*статья\s*([0-9]+(?:[-/][0-9]+)*){_REFERENCE}\b", "Статья {n}", None),
    (3, rf"^\s*ст\.\s*([0-9]+(?:[-/][0-9]+)*){_REFERENCE}\b", "Ст. {n}", None),
    (4, r"^\s*(?:пункт|п\.)\s*([0-9]+(?:\.[0-9]+)*)", "п. {n}", None),
    (4, r"^\s*(?:punctul|pct\.)\s*([0-9]+(?:\.[0-9]+)*)", "pct. {n}", None),
    (4, r"^\s*([0-9]+(?:\.[0-9]+)+)\.?\s+", "pct. {n}", None),
    (4, r"^\s*([0-9]+)\.\s+(?!\d{1,2}\.)", "pct. {n}", None),
    (5, r"^\s*(?:часть|ч\.)\s*\(?([0-9]+)\)?", "ч. ({n})", None),
    (5, r"^\s*(?:alineatul|alin\.)\s*\(?([0-9]+)\)?", "alin. ({n})", None),
    (5, r"^\s*\(([0-9]+)\)\s+", "alin. ({n})", None),
    (6, r"^\s*(?:подпункт|пп\.)\s*([a-zA-Zа-яА-Я])\)", "подп. {n})", None),
    (6, r"^\s*(?:litera|lit\.)\s*([a-zA-Zа-яА-Я])\)", "lit. {n})", None),
    (6, r"^\s*([a-zA-Zа-яА-Я])\)\s+", "lit. {n})", None),
]
THOUSANDS, NUMERAL = r"(?<=\d)[\s .](?=\d{3}\b)", r"\d+(?:[.,]\d+)?"


def act_type(text: Column) -> Column:
    """The type named first in a text; null if none is. One search finds it, as no two types begin alike, and the word found tells which it is."""
    named = lambda m: reduce(lambda c, kind: c.when(m.rlike(rf"(?iu)^(?:{kind[1]})"), kind[0]), ACT_TYPES.items(), F.when(m == "", None))
    return let(F.regexp_extract(text, rf"(?iuU)(?=[{ACT_BEGINS}])\b(?:{'|'.join(ACT_TYPES.values())})\b", 0), named)


def act_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda n: F.regexp_replace(n, r"(?U)\s+", ""))


def reconciled_number(link: Column, head: Column) -> Column:
    """The number of a link, written as in the document's head where the digits agree; without one, the head's first."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    both = F.struct(act_numbers(head).alias("heads"), F.get(act_numbers(link), 0).alias("own"))
    same = lambda b: let(digits(b["own"]), lambda d: F.get(F.filter(b["heads"], lambda n: digits(n) == d), 0))
    return let(both, lambda b: F.when(b["own"].isNull(), F.get(b["heads"], 0)).otherwise(F.coalesce(same(b), b["own"])))


def act_date(text: Column) -> Column:
    """The earliest date of a text, yyyy-mm-dd, in figures or month words; dashes and underlines also count as spaces. Only ranges are checked.

    A text without a year is not searched, and parts are taken from a date that was found. A look at the digit comes before that at the word's border, which costs more.
    """
    month = F.create_map(*[F.lit(x) for names in (MONTHS_RO, MONTHS_RU) for i, m in enumerate(names, 1) for x in (m, i)])
    figures = r"(?U)(?=\d)\b(\d{1,2})[./_-](\d{1,2})[./_-](\d{4})\b"
    named = rf"(?iuU)(?=\d)\b(\d{{1,2}})\s+({'|'.join(MONTHS_RO + MONTHS_RU)})\s+(\d{{4}})\b"

    def first(t: Column, p: str, number: Callable[[Column], Column]) -> Column:
        part = lambda m, i: F.regexp_extract(m, p, i)
        spot = lambda m: F.struct(F.regexp_instr(t, F.lit(p)).alias("at"), part(m, 3).try_cast("int").alias("y"), number(part(m, 2)).alias("m"), part(m, 1).try_cast("int").alias("d"))
        return let(F.regexp_extract(t, p, 0), lambda m: F.when(m != "", spot(m)))

    def earliest(v: Column) -> Column:
        in_figures, in_words = lambda n: n.try_cast("int"), lambda n: F.try_element_at(month, F.lower(n))
        spots = F.array(*[first(t, p, number) for t in (v["t"], v["u"]) for p, number in ((figures, in_figures), (named, in_words))])
        return F.array_min(F.filter(spots, lambda s: s["y"].between(1990, 2100) & s["m"].between(1, 12) & s["d"].between(1, 31)))

    both = let(text, lambda t: F.struct(t.alias("t"), F.when(t.rlike("[-_]"), F.regexp_replace(t, "[-_]+", " ")).alias("u")))
    shown = lambda b: F.when(b.isNotNull(), F.format_string("%04d-%02d-%02d", b["y"], b["m"], b["d"]))
    return F.when(text.rlike("199[0-9]|20[0-9]{2}|2100"), let(both, lambda v: let(earliest(v), shown)))


def legal_item(text: Column) -> Column:
    """struct<level,label> of the legal item that a text begins; null if it begins none, or with a date."""
    return let(text, _legal_item)


def _legal_item(text: Column) -> Column:
    item = F.lit(None).cast("struct<level:int,label:string>")
    for level, pattern, label, bare in reversed(LEGAL_ITEMS):
        p = "(?iuU)" + pattern
        n = F.regexp_extract(text, p, 1)
        shown = F.concat(F.lit(label.split("{n}")[0]), n, F.lit(label.split("{n}")[1]))
        if bare:
            shown = F.when(n == "", bare).otherwise(shown)
        item = F.when(text.rlike(p), F.struct(F.lit(level).alias("level"), shown.alias("label"))).otherwise(item)
    return F.when(~text.rlike(r"(?U)^\s*\d{1,2}\.\d{1,2}\.\d{4}\b"), item)


def _plain(n: Column) -> Column:
    bare = F.ltrim(n, F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def _numerals(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "(?U)" + THOUSANDS, ""), F.lit("(?U)" + NUMERAL), F.lit(0)), lambda n: F.translate(n, ",", "."))


def claim_numbers(text: Column) -> Column:
    """Numbers of a claim in one form: no thousands marks, a point for a comma, no leading zeros."""
    return F.array_distinct(F.transform(_numerals(text), _plain))


def evidence_numbers(text: Column) -> Column:
    """The same, and the parts around a point, so 01.04 also backs 1 and 4."""
    return F.array_distinct(F.flatten(F.transform(_numerals(text), lambda n: F.concat(F.array(_plain(n)), F.transform(F.split(n, r"\."), _plain)))))


def numbers_backed(claim: Column, evidence: Column) -> Column:
    """Whether every number of a claim is in its evidence (an array of texts)."""
    have = F.flatten(F.transform(evidence, evidence_numbers))
    return F.size(F.array_except(claim_numbers(claim), have)) == 0


def copied_from(value: Column, evidence: Column) -> Column:
    """Whether an address or opening hours come from the evidence: all its numbers are there, and all its words of three letters or more, accents aside."""
    plain = lambda t: F.filter(words(folded(t)), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$"))
    have = F.flatten(F.transform(evidence, plain))
    return numbers_backed(value, evidence) & (F.size(F.array_except(plain(value), have)) == 0)


def citation_label(kind: Column, title: Column, doc_type: Column, number: Column, date: Column, legal_path: Column, section: Column) -> Column:
    """How a chunk is cited: the act with number and date, or its title, and the place within."""
    filled = lambda c: c.isNotNull() & (c != "")
    act = F.concat(F.upper(F.substring(doc_type, 1, 1)), F.lower(F.substring(doc_type, 2, 1000)), F.when(filled(number), F.concat(F.lit(" nr. "), number)).otherwise(""), F.when(filled(date), F.concat(F.lit(" din "), date)).otherwise(""))
    base = F.when(filled(doc_type) & (filled(number) | filled(date)), act).when(filled(title), F.substring(title, 1, 80)).otherwise("Document")
    place = F.when(F.size(legal_path) > 0, legal_path).otherwise(section)
    file = F.array_join(F.concat(F.array(base), place), " › ")
    page = F.array_join(F.concat(F.array(F.coalesce(title, F.lit(""))), section), " › ")
    return F.when(kind == "page", page).otherwise(file)
