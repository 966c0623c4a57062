"""Romanian and Russian stems by the published Snowball rules, and the words of a text as a search index has them.

A rule looks for the longest of its suffixes and applies only if that one lies in a region of the word: RV begins after the first vowels and consonants that
the language names, R1 after the first vowel and consonant, R2 is R1 of what is left of R1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from functools import lru_cache

# The vowels and suffixes of the published rules. Keys of the tables are what takes a suffix's place.
RO_VOWELS = "aeiouăâî"
RO_ARTICLES = {"": "ul ului", "a": "aua", "e": "ea ele elor", "i": "ii iua iei iile iilor ilor ile", "at": "atei", "ați": "ație ația"}
RO_COMBINED = {
    "abil": "abilitate abilitati abilităi abilități",
    "ibil": "ibilitate",
    "iv": "ivitate ivitati ivităi ivități",
    "ic": "icitate icitati icităi icități icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    "at": "ativ ativa ative ativi ativă ațiune atoare ator atori ătoare ător ători",
    "it": "itiv itiva itive itivi itivă ițiune itoare itor itori",
}
RO_DERIVED = {
    "": "at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oși ant anta ante anti antă ator atori itate itati ităi ități iv iva ive ivi ivă",
    "t": "iune iuni",
    "ist": "ism isme ist ista iste isti istă iști",
}
RO_VERBS_AFTER_CONSONANT = (
    "are ere ire âre ind ând indu ându eze ească ez ezi ează esc ești ește ăsc ăști ăște am ai au eam eai ea eați eau iam iai ia iați iau "
    "ui ași arăm arăți ară uși urăm urăți ură iși irăm irăți iră âi âși ârăm ârăți âră asem aseși ase aserăm aserăți aseră isem iseși ise iserăm iserăți iseră "
    "âsem âseși âse âserăm âserăți âseră usem useși use userăm userăți useră"
)
RO_VERBS = "ăm ați em eți im iți âm âți seși serăm serăți seră sei se sesem seseși sese seserăm seserăți seseră"
RO_ENDINGS = "a e i ie ă"

RU_VOWELS = "аеиоуыэюя"
RU_GERUNDS_AFTER_A, RU_GERUNDS = "в вши вшись", "ив ивши ившись ыв ывши ывшись"
RU_ADJECTIVES = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
RU_PARTICIPLES_AFTER_A, RU_PARTICIPLES = "ем нн вш ющ щ", "ивш ывш ующ"
RU_REFLEXIVES = "ся сь"
RU_VERBS_AFTER_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
RU_VERBS = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
RU_NOUNS = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
RU_DERIVED = "ост ость"
RU_SUPERLATIVES = "ейш ейше"
#: Words that a Russian index leaves out.
RU_STOP_WORDS = frozenset(
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между".split()
)


def classes(table: Mapping[str, str]) -> dict[str, str]:
    """The replacement of each suffix."""
    return {suffix: new for new, suffixes in table.items() for suffix in suffixes.split()}


class _Suffixes(dict):
    """Suffixes with what is known of each, and the lengths of those that end with a letter, longest first."""

    def __init__(self, known: Mapping[str, object]):
        super().__init__(known)
        self.lengths = {c: sorted({len(s) for s in known if s.endswith(c)}, reverse=True) for c in {s[-1] for s in known}}


_ARTICLES, _COMBINED, _DERIVED = (_Suffixes(classes(x)) for x in (RO_ARTICLES, RO_COMBINED, RO_DERIVED))
_ANY_VERB = _Suffixes(dict.fromkeys(RO_VERBS_AFTER_CONSONANT.split(), True) | dict.fromkeys(RO_VERBS.split(), False))
_ENDINGS = _Suffixes(dict.fromkeys(RO_ENDINGS.split(), ""))


def _after_a(some: str, any_: str) -> _Suffixes:
    return _Suffixes(dict.fromkeys(some.split(), True) | dict.fromkeys(any_.split(), False))


_GERUNDS, _PARTICIPLES, _VERBS = _after_a(RU_GERUNDS_AFTER_A, RU_GERUNDS), _after_a(RU_PARTICIPLES_AFTER_A, RU_PARTICIPLES), _after_a(RU_VERBS_AFTER_A, RU_VERBS)
_ADJECTIVES, _REFLEXIVES, _NOUNS, _DERIVED_RU, _LAST_RU = (_after_a("", x) for x in (RU_ADJECTIVES, RU_REFLEXIVES, RU_NOUNS, RU_DERIVED, RU_SUPERLATIVES + " н ь"))


def region_patterns(vowels: str) -> tuple[str, str, str]:
    """What stands before RV (Romanian), R1 and R2."""
    v, c = f"[{vowels}]", f"[^{vowels}]"
    return f"^(?:{v}{c}+{v}|{v}{v}+{c}|{c}{c}+{v}|{c}{v}.)", f"^{c}*{v}+{c}", f"^{c}*{v}+{c}+{v}+{c}"


_RV, _R1, _R2 = (re.compile(p) for p in region_patterns(RO_VOWELS))
_BETWEEN = re.compile(f"([{RO_VOWELS}])([ui])(?=[{RO_VOWELS}])")
_RU_HEAD, _RU_R2 = re.compile(f"[^{RU_VOWELS}]*[{RU_VOWELS}]"), re.compile(f"[{RU_VOWELS}]*[^{RU_VOWELS}]+[{RU_VOWELS}]+[^{RU_VOWELS}]")


def _begin(pattern: re.Pattern, word: str) -> int:
    m = pattern.match(word)
    return m.end() if m else len(word)


def _suffix(word: str, known: _Suffixes) -> str:
    """The longest known suffix, or none."""
    for n in known.lengths.get(word[-1:], ()):
        if word[-n:] in known:
            return word[-n:]
    return ""


def _semivowels(word: str) -> str:
    """u and i between vowels as capitals, which count as consonants."""
    return _BETWEEN.sub(lambda m: m[1] + m[2].upper(), word)


def romanian(word: str) -> str:
    """The stem of a word in lower case."""
    word = whole = _semivowels(word if word.isascii() else word.translate(_COMMA_BELOW))
    r1 = _begin(_R1, word)
    cut = _suffix(word, _ARTICLES)
    stem = word[: len(word) - len(cut)]
    if cut and len(stem) >= r1 and not (cut == "ile" and stem.endswith("ab")):
        word = stem + _ARTICLES[cut]
    derived = False
    while (cut := _suffix(word, _COMBINED)) and len(word) - len(cut) >= r1:
        word, derived = word[: -len(cut)] + _COMBINED[cut], True
    cut = _suffix(word, _DERIVED)
    stem = word[: len(word) - len(cut)]
    if cut and len(stem) >= r1 and len(stem) >= _begin(_R2, whole) and (_DERIVED[cut] != "t" or stem.endswith("ț")):
        word, derived = (stem[:-1] if _DERIVED[cut] == "t" else stem) + _DERIVED[cut], True
    rv = _begin(_RV, whole)
    if not derived and len(word) >= rv:
        inner = word[rv:]
        cut = _suffix(inner, _ANY_VERB)
        before = inner[: len(inner) - len(cut)]
        if cut and (not _ANY_VERB[cut] or before and (before[-1] not in RO_VOWELS or before[-1] == "u")):
            word = word[: -len(cut)]
    cut = _suffix(word, _ENDINGS)
    if cut and len(word) - len(cut) >= rv:
        word = word[: -len(cut)]
    return word.lower()


def _without(inner: str, known: _Suffixes) -> str | None:
    """A region without its suffix, or None if it has none or one that must follow а or я and doesn't."""
    cut = _suffix(inner, known)
    stem = inner[: len(inner) - len(cut)]
    return stem if cut and (not known[cut] or stem.endswith(("а", "я"))) else None


def russian(word: str) -> str:
    """The stem of a word in lower case."""
    word = word.replace("ё", "е")
    m = _RU_HEAD.match(word)
    if not m:
        return word
    head, inner = word[: m.end()], word[m.end() :]
    found = _RU_R2.match(inner)
    r2 = found.end() if found else len(inner)
    done = _without(inner, _GERUNDS)
    if done is None:
        inner = inner if (x := _without(inner, _REFLEXIVES)) is None else x
        done = _without(inner, _ADJECTIVES)
        if done is not None:
            done = done if (x := _without(done, _PARTICIPLES)) is None else x
        else:
            done = next((x for x in (_without(inner, _VERBS), _without(inner, _NOUNS)) if x is not None), inner)
    inner = done.removesuffix("и")
    cut = _suffix(inner, _DERIVED_RU)
    if cut and len(inner) - len(cut) >= r2:
        inner = inner[: -len(cut)]
    cut = _suffix(inner, _LAST_RU)
    if cut in ("ейш", "ейше"):
        inner = inner[: -len(cut)]
        inner = inner[:-1] if inner.endswith("нн") else inner
    elif cut == "ь" or cut == "н" and inner.endswith("нн"):
        inner = inner[:-1]
    return head + inner


_COMMA_BELOW = str.maketrans("şţ", "șț")


def _plain_letters() -> dict[int, str]:
    """Latin and Greek letters with marks as what they are without them, and a few that are more than one letter."""
    out = {}
    for c in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)]:
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if bare != chr(c):
            out[c] = bare
    return out | str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ё": "е", "Ё": "Е"})


_PLAIN = _plain_letters()
_PLAIN_OF = {chr(c): plain for c, plain in _PLAIN.items()}
#: Letters whose plain form has a plain form of its own; it stays as it is.
_TWICE = frozenset(c for c, plain in _PLAIN_OF.items() if not _PLAIN_OF.keys().isdisjoint(plain))
_MARKS = re.compile("[̀-ͯ]")
_WORD = re.compile(r"\w+")


def _plain(text: str) -> str:
    found = _PLAIN_OF.keys() & set(text)
    if not _TWICE.isdisjoint(found):
        return text.translate(_PLAIN)
    for c in found:  # a few letters, each by one search
        text = text.replace(c, _PLAIN_OF[c])
    return text


@lru_cache(1 << 18)
def _stem(word: str, russian_rules: bool) -> str:
    word = word.lower()
    if not russian_rules:
        return romanian(word)
    return "" if word in RU_STOP_WORDS else russian(word)


def index_words(text: str, language: str | None) -> list[str]:
    """The stems of a text in order, accents gone; Russian texts by the Russian rules and without stop words (an empty place each), all others by the Romanian ones."""
    if not text.isascii():
        text = _MARKS.sub("", _plain(text))
    ru = language == "ru"
    return [_stem(w, ru) for w in _WORD.findall(text)]


@lru_cache(1)
def _all_marks() -> frozenset[str]:
    return frozenset(c for c in map(chr, range(0x300, 0x110000)) if unicodedata.category(c)[0] == "M")


def plain_words(text: str) -> list[str]:
    """The words of a text in order, in lower case and without any marks: letters, numbers and underscores."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        for mark in _all_marks().intersection(text):
            text = text.replace(mark, "")
        text = unicodedata.normalize("NFC", text).replace("ß", "ss").replace("Σ", "σ")
    return _WORD.findall(text.lower())
