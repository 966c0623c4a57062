"""Text expressions: language, scripts, contacts, masking, analysis for search, table rendering.

Patterns are Unicode-aware: (?U) makes \\w, \\b and \\d so, (?iu) folds case beyond ASCII.
"""

from __future__ import annotations

import html.entities as entities
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import let
from lectern.functions.stemming import index_words

# Fixed values.
RO_WORDS = ["și", "si", "în", "de", "la", "cu", "pentru", "din", "privind", "care", "este", "al", "ale", "sau"]
EN_WORDS = ["the", "and", "of", "to", "for", "with", "is", "are", "on", "your", "you", "by", "from", "this"]
LANGUAGES = ["ro", "ru", "en", "uk"]
LANGUAGE_CODES = {"ron": "ro", "rum": "ro", "rus": "ru", "eng": "en", "ukr": "uk"}
STOP_WORDS = (
    "cat cât cum unde ce care pentru este sunt cine cand când daca dacă acest aceasta aceste acesti acești "
    "как где что какой какая какие сколько для это эта этот эти или кто когда почему зачем было быть есть будет"
).split()
PHONE = r"(?U)(?:(?:\+373|0)\s*\(?\d{2,3}\)?[\s.-]*\d{2,3}[\s.-]*\d{2,4})"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PERSONAL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\d[\d\s().-]{5,}\d"
MASK, MASKED_LENGTH = "•••", 200
ITEM_LINE = r"\[\d+/\d+]\s+(\S+)(?:\s+\(ocr\))?\s+(\S+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def collapsed(text: Column) -> Column:
    """White space made single, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def script_counts(text: Column) -> Column:
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.struct(count(r"[\p{IsCyrillic}&&\p{L}]").alias("cyrillic"), count(r"[\p{IsLatin}&&\p{L}]").alias("latin"), count("[іїєґІЇЄҐ]").alias("ukrainian"))


def detected_language(text: Column) -> Column:
    """ro, ru, uk or en by script, Ukrainian letters and function words; null without letters."""
    n = script_counts(text)
    known = lambda ws: F.size(F.filter(words(F.lower(text)), lambda w: w.isin(ws)))
    return (
        F.when((n["cyrillic"] == 0) & (n["latin"] == 0), F.lit(None))
        .when((n["cyrillic"] > n["latin"]) & (n["ukrainian"] > 0.01 * n["cyrillic"]), "uk")
        .when(n["cyrillic"] > n["latin"], "ru")
        .when(known(EN_WORDS) > known(RO_WORDS), "en")
        .otherwise("ro")
    )


def question_language(text: Column, chosen: Column, letters: int = 5) -> Column:
    """The language of a question; of one with fewer than `letters` letters, and of Ukrainian ones, that of the page it is asked on and Russian."""
    n = script_counts(text)
    found = detected_language(text)
    return F.when(n["cyrillic"] + n["latin"] < letters, chosen).otherwise(F.when(found == "uk", "ru").otherwise(F.coalesce(found, chosen)))


def language_code(code: Column, fallback: Column) -> Column:
    """A two-letter code from a tag such as ru-RU or ron, else the language of a fallback text, else ro."""
    head = F.split_part(F.translate(F.lower(F.trim(code)), "_", "-"), F.lit("-"), F.lit(1))
    three = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    return F.coalesce(F.when(head.isin(LANGUAGES), head), F.try_element_at(three, head), F.when(F.length(fallback) > 0, detected_language(fallback)), F.lit("ro"))


def has_contacts(text: Column) -> Column:
    return text.rlike(PHONE) | text.rlike(EMAIL)


def emails(text: Column) -> Column:
    """Distinct e-mail addresses in order, a www. prefix removed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda e: F.regexp_replace(e, r"(?i)^www\.", "")))


def valid_phone(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return digits.rlike("^0[1-9][0-9]{7}$") | digits.rlike("^373[0-9]{8}$")


def phones(text: Column) -> Column:
    """Distinct valid phone numbers in order, as written. A match goes on by groups of digits until it has a whole number."""
    more = r"(?:[\s.-]{0,2}\d{2,3})"
    form = PHONE.removeprefix("(?U)")
    found = F.regexp_extract_all(text, F.lit(rf"(?U)\(?{form}{more}{{0,3}}"), F.lit(0))
    cuts = lambda m: F.array(*[F.regexp_replace(F.regexp_extract(m, rf"(?U)^\(?{form}{more}{{{n}}}", 0), r"^[ .-]+|[ .-]+$", "") for n in range(4)])
    shortest = F.transform(found, lambda m: F.get(F.filter(cuts(m), valid_phone), 0))
    return F.array_distinct(F.filter(shortest, lambda p: p.isNotNull()))


def masked(text: Column) -> Column:
    """Personal data masked, then cut with an ellipsis."""
    m = F.regexp_replace(text, PERSONAL, MASK)
    return F.when(F.length(m) > MASKED_LENGTH, F.concat(F.substring(m, 1, MASKED_LENGTH - 1), F.lit("…"))).otherwise(m)


def question_key(text: Column) -> Column:
    """One key for wordings of a question that differ in case, spaces and end marks."""
    return F.lower(F.regexp_replace(collapsed(text), r"[?!. ]+$", ""))


def qualifies(question: Column) -> Column:
    """Long enough, short enough and without personal data."""
    return F.length(F.trim(question)).between(10, 120) & (masked(question) == question)


def query_terms(text: Column) -> Column:
    """Terms of a search: operators and edge punctuation removed, short words and stop words left out; if none is left, those of two characters or more."""
    raw = F.transform(F.split(F.trim(text), r"(?U)\s+"), lambda t: F.regexp_replace(F.regexp_replace(t, r"[&|!()\\:*'\"]", ""), r"(?U)^[\W_]+|[\W_]+$", ""))
    useful = F.filter(raw, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(STOP_WORDS))
    return F.when(F.size(useful) > 0, useful).otherwise(F.filter(raw, lambda t: F.length(t) >= 2))


#: Texts of a batch that are Python objects at a time.
TEXTS_AT_ONCE = 128


def _pieces(n: int, kind: pa.DataType, make: Callable[[int, int], list]) -> pa.Array:
    """What `make` gives for the rows of a batch, a few at a time, so that only Arrow holds all of them."""
    found = [pa.array(make(at, TEXTS_AT_ONCE), kind) for at in range(0, n, TEXTS_AT_ONCE)]
    return pa.concat_arrays(found) if found else pa.array([], kind)


def _series(f: Callable[[str], str]):
    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        return _pieces(len(s), pa.string(), lambda at, n: [None if t is None else f(t) for t in s.slice(at, n).to_pylist()])

    return run


def _bare_letters() -> tuple[str, str]:
    """All letters below U+2000 that are one letter with marks, and these letters."""
    marked = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in marked if len(d) > 1 and not unicodedata.combining(d[0]) and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def unaccented(text: Column) -> Column:
    """Accents and other combining marks removed, all else kept."""
    return F.regexp_replace(F.translate(text, *_bare_letters()), r"\p{Mn}", "")


def folded(text: Column) -> Column:
    """For comparing words: no accents, lower case."""
    return unaccented(F.lower(text))


def _names() -> Column:
    """Names of single characters below U+3000, with their semicolons."""
    pairs = [(n, c) for n, c in entities.html5.items() if n.endswith(";") and len(c) == 1 and ord(c) < 0x3000 and len(n) <= 9]
    return F.map_from_arrays(F.lit([n for n, _ in pairs]), F.lit([c for _, c in pairs]))


def unescaped(text: Column) -> Column:
    """Character references decoded once: decimal, hexadecimal and named ones; unknown ones stay."""
    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,7});"
    names = _names()

    def decoded(ref: Column) -> Column:
        body = F.substring(ref, 2, 100)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.regexp_extract(body, "^#[xX](.*);$", 1), 16, 10)).when(body.startswith("#"), F.regexp_extract(body, "^#(.*);$", 1)).try_cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.try_element_at(names, body), ref)

    parts = F.split(text, pattern, -1)
    refs = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), decoded), F.array(F.lit("")))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.zip_with(parts, refs, lambda a, b: F.concat(a, b)), "")).otherwise(text)


def parsed_time(text: Column) -> Column:
    """The instant of an ISO 8601 text; one without a zone is UTC, anything else is null."""
    ok = F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    whole = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(whole.rlike(r"(Z|[T ].*[+-]\d{2}:\d{2})$"), whole).when(whole.rlike("[T ]"), F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("T00:00:00Z")))
    return F.when(ok, F.try_to_timestamp(zoned))


def shown_time(at: Column) -> Column:
    """An instant in seconds, UTC, as ISO 8601."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def current_item(log: Column) -> Column:
    """What a stage works on, from the lines of its log: outcome and name of the last item line; null without one."""
    last = F.get(F.reverse(F.filter(log, lambda x: x.rlike(ITEM_LINE))), 0)
    target = F.regexp_replace(F.regexp_extract(last, ITEM_LINE, 2), "/+$", "")
    name = F.regexp_extract(target, "([^/]*)$", 1)
    return F.when(last.isNotNull(), F.substring(F.concat_ws(" ", F.regexp_extract(last, ITEM_LINE, 1), F.when(name == "", target).otherwise(name)), 1, 120))


def lexemes(text: Column, language: Column) -> Column:
    """The stems of a text in order; Russian rows by the Russian rules and without stop words, all others by the Romanian ones."""

    @F.arrow_udf("array<string>")
    def run(s: pa.Array, lang: pa.Array) -> pa.Array:
        rows = lambda at, n: zip(s.slice(at, n).to_pylist(), lang.slice(at, n).to_pylist(), strict=True)
        return _pieces(len(s), pa.list_(pa.string()), lambda at, n: [None if t is None else [w for w in index_words(t, k) if w] for t, k in rows(at, n)])

    return run(text, language)


# Characters repaired in all texts, and letters that look alike in two scripts.
REPAIRS = {"ş": "ș", "Ş": "Ș", "ţ": "ț", "Ţ": "Ț", " ": " ", " ": " ", " ": " ", "­": "", "ﬁ": "fi", "ﬂ": "fl"}
LATIN_ALIKE, CYRILLIC_ALIKE = "aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ"


def _one_script(word: str) -> str:
    """A word of two scripts in the script of most of its letters, if all its other letters have a likeness there."""
    kinds = ["" if not c.isalpha() else unicodedata.name(c, "").partition(" ")[0] for c in word]
    latin, cyrillic = kinds.count("LATIN"), kinds.count("CYRILLIC")
    if not latin or not cyrillic or latin == cyrillic:
        return word
    few, source, target = ("LATIN", LATIN_ALIKE, CYRILLIC_ALIKE) if cyrillic > latin else ("CYRILLIC", CYRILLIC_ALIKE, LATIN_ALIKE)
    alike = dict(zip(source, target, strict=True))
    if any(k == few and c not in alike for c, k in zip(word, kinds, strict=True)):
        return word
    return "".join(alike[c] if k == few else c for c, k in zip(word, kinds, strict=True))


def normalised(text: Column) -> Column:
    """Composed characters, repaired letters, words of one script and single spaces in trimmed lines."""
    import re

    repairs = str.maketrans(REPAIRS)

    def clean(t: str) -> str:
        t = re.sub(r"\w+", lambda m: m[0] if m[0].isascii() else _one_script(m[0]), unicodedata.normalize("NFC", t).translate(repairs))
        return "\n".join(re.sub(r"[ \t]+", " ", line).strip() for line in t.split("\n")).strip()

    return _series(clean)(text)


def markdown_table(header: Column, rows: Column) -> Column:
    """A table in Markdown, every row padded to the widest; empty without columns."""
    widest = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def table(width: Column) -> Column:
        padded = lambda r: F.when(F.size(r) == width, r).otherwise(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
        body = F.concat(F.array(line(padded(header)), line(F.array_repeat(F.lit("---"), width))), F.transform(rows, lambda r: line(padded(r))))
        return F.when(width > 0, F.array_join(body, "\n")).otherwise(F.lit(""))

    return let(widest, table)  # looked up for each row, it would be found anew from all rows
