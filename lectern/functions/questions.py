"""Expressions about questions, sites and results: categories, kinds of questions, overlap, recency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import let
from lectern.functions.acts import MONTHS_RO, MONTHS_RU

# Rules of categories, tried in order, by host and then by text; patterns of questions.
HOST_CATEGORIES = {
    "education": "dets|educ|scoal|gradinit|extrascolar|liceu|gimnazi",
    "healthcare": "amt|sanat|spital|dgams|medic",
    "district": "pretura|botanica|ciocana|rascani|riscani|buiucani|centru",
    "mobility": "mobil|transport|autourban|rtec|exdrupo",
    "urban_utilities": "salubr|apa|lift|termo|dgaurf|dglca|agsv",
    "transparency": r"(?:^|\.)chisinau\.md$|proiecte|suburbii|transparen",
}
TEXT_CATEGORIES = {
    "education": r"școal|scoal|liceu|grădiniț|gradinit|educați|educati|elev|школ|лице|детск\w* сад|образовани",
    "healthcare": "spital|sănăt|sanat|medic|clinic|policlinic|больниц|здоров|медицин|поликлиник",
    "district": "pretur|sector|претур|сектор",
    "mobility": "transport|parcar|trafic|troleibuz|autobuz|транспорт|парковк|троллейбус|автобус",
    "urban_utilities": "urbanism|arhitect|salubr|deșeu|deseu|apă|apa-canal|termic|lift|градострои|архитект|отход|водоснаб|отоплен",
    "services": "servici|turism|comerț|comert|invest|tineret|услуг|туризм|торгов|инвест|молод",
    "transparency": "primări|primari|consiliul municipal|decizi|dispoziți|transparen|примэри|мэри|решени|распоряжени",
}
NOW = r"(?iuU)^\W*(cine|care|când|cand|кто|какой|какая|какие|каков\w*|когда|who|which|when)\b"
MEMBERS = r"(?iuU)\b(membri\w*|componen\w*|cine (?:face|fac) parte|din cine|состав\w*|член\w*|кто входит|входят|președinte\w*|secretar\w*|председател\w*|секретар\w*)"
SMALL_TALK = (
    r"(?iuU)^\W*(?:(?:salut\w*|bun[aă](?: ziua| seara| dimineața| dimineata)?|noroc|hei|hello|hi|hey|привет\w*|здравствуй\w*|добр\w+ (?:день|утро|вечер)|добрый|хай|mul[țt]umesc\w*|mersi|merci"
    r"|спасибо|благодарю|thanks?(?: you)?|la revedere|pa|пока|до свидания|bye|ce faci|ce mai faci|как дела|как ты|cine e[șs]ti|cine sunte[țt]i|ce po[țt]i(?: face)?|кто ты|кто вы|что ты умеешь"
    r"|что умеешь|что вы умеете)[\s!.,?)(]*)+$"
)
ACT_NUMBER = r"(?iuU)\b\d+(?:/\d+(?:-\d+)?|-[a-zа-я]{1,2})\b"
ROLE = r"(?iuU)\b(membr[ui]\w*|președint\w*|vicepreședint\w*|secretar\w*|coordonator\w*|член\w*|председател\w*|секретар\w*|заместител\w*)"
NUMBERED_NAME = r"(?U)^\s*\d+[.)]\s+[A-ZĂÂÎȘȚА-ЯЁ][\w-]+\s+[A-ZĂÂÎȘȚА-ЯЁ][\w-]+\s*[,–—-]"
NO_QUESTION_LINE = r"(?iu)^(pagin[aă]|pagina|anexa|articolul|capitolul|data|nr\.)"


def category(host: Column, text: Column) -> Column:
    """struct<category,how>: the first rule whose pattern is in the host, else in the text, else other."""
    out = F.struct(F.lit("other").alias("category"), F.lit("default").alias("how"))
    rules = [(host, p, name, "rule") for name, p in HOST_CATEGORIES.items()] + [(text, "(?iuU)" + p, name, "keywords") for name, p in TEXT_CATEGORIES.items()]
    for column, pattern, name, how in reversed(rules):
        out = F.when(column.rlike(pattern), F.struct(F.lit(name).alias("category"), F.lit(how).alias("how"))).otherwise(out)
    return out


def asks_for_now(text: Column) -> Column:
    return text.rlike(NOW)


def asks_for_members(text: Column) -> Column:
    return text.rlike(MEMBERS)


def small_talk(text: Column) -> Column:
    return text.rlike(SMALL_TALK)


def act_numbers_asked(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ACT_NUMBER), F.lit(0)))


def act_patterns(number: Column, date: Column) -> Column:
    """The ways in which a text names an act: by number, and by number and date."""
    day = F.regexp_replace(date, r"^(\d{4})-(\d{2})-(\d{2})$", "$3.$2.$1")
    named = [F.concat(F.lit(p), number) for p in ("nr. ", "nr.", "nr ")]
    return F.filter(F.array(*named, F.concat(number, F.lit(" din "), day)), lambda p: p.isNotNull())


def is_act(doc_type: Column, number: Column) -> Column:
    return F.coalesce(doc_type != "page", F.lit(False)) & F.coalesce(number != "", F.lit(False))


def overlap(question: Column, line: Column, letters: int = 4) -> Column:
    """The share of a question's words of `letters` letters or more that a line has too; null without such words."""
    long = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) >= letters))
    return let(F.struct(long(question).alias("q"), long(line).alias("l")), lambda v: F.try_divide(F.size(F.array_intersect(v["q"], v["l"])), F.size(v["q"])))


def latest_date(text: Column, today: Column) -> Column:
    """The latest whole date of a text up to today, yyyy-mm-dd: an undated document is at least as recent."""
    figures = r"(?U)\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b"
    names = "|".join(MONTHS_RO + MONTHS_RU)
    worded = rf"(?iuU)\b(\d{{1,2}})\s+({names})\s+(\d{{4}})\b"
    month = F.create_map(*[F.lit(x) for group in (MONTHS_RO, MONTHS_RU) for i, m in enumerate(group, 1) for x in (m, str(i))])
    get = lambda p, n: F.regexp_extract_all(text, F.lit(p), F.lit(n))
    zipped = lambda p, name: F.zip_with(F.arrays_zip(get(p, 3).alias("y"), get(p, 2).alias("m")), get(p, 1), lambda ym, d: F.struct(ym["y"].alias("y"), name(ym["m"]).alias("m"), d.alias("d")))
    parts = F.concat(zipped(figures, lambda m: m), zipped(worded, lambda m: F.try_element_at(month, F.lower(m))))
    valid = F.filter(parts, lambda x: (x["y"] >= "1990") & x["m"].cast("int").between(1, 12) & x["d"].cast("int").between(1, 31))
    shown = F.transform(valid, lambda x: F.concat_ws("-", x["y"], F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0")))
    return F.array_max(F.filter(shown, lambda t: t <= today))


def is_roster(text: Column) -> Column:
    """Whether a text lists people with their roles: three lines or more with a role, as table rows or numbered names."""
    fits = lambda t: t.rlike(ROLE) & ((F.length(F.regexp_replace(t, r"[^|]", "")) >= 2) | t.rlike(NUMBERED_NAME))
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), fits)) >= 3


def asks_well(line: Column) -> Column:
    """Whether a line can be asked about: neither short nor long, no page mark, not only figures."""
    return F.length(line).between(50, 320) & ~line.rlike(NO_QUESTION_LINE) & ~line.rlike(r"^[0-9.\-\s:,]+$")
