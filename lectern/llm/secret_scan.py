"""Secret scans with DataFrame functions only.

Three base patterns (assignments, access keys, hexadecimal runs) plus a sliding-window Shannon
entropy scan over token-like candidate strings. The entropy of a window is held as
sum(c * log2 c) over its character counts, in integer millionths of a bit, and updated by
the character that enters and the one that leaves, so a candidate costs one pass.

Defined results: a null text counts as empty; empty texts, texts without spans and empty tables give
zero counts and empty strings; repeated rows give repeated results; of spans that begin at the same place the kind listed first comes
first; extra columns are kept, but `scan` replaces columns named like its results. Everything is row-local, so no key can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. The base patterns; the first one spells out both cases of its key words.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE_MIN = 8

#: Entropy scan parameters: window length, candidate pattern, and the least bits a character for a
#: window of hexadecimal digits only and for any other window (which needs letters and two digits).
WINDOW = 24
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
MIN_BITS = {"hex": 3.0, "mixed": 3.9}
#: Candidates that are wholly of one of these forms are never reported by the entropy scan, nor do windows count that hold a placeholder.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh"
ALLOW_LIST = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{0,4}$",
)
KINDS = ("assign", "access", "hex", "entropy")
UNIT = 1_000_000
_FIRST_CODE, _CODES = 43, 80  # '+' to 'z'
_BLOCK = 256
_SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"
_RUNS = "array<struct<start:int,end:int>>"


def weight_table(window: int) -> list[int]:
    """c * log2(c) in integer millionths, for c from 0 to `window`."""
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, window + 1)]


def most_weight(window: int, bits: float) -> int:
    """The largest sum of weights at which a window still has `bits` bits a character."""
    return math.floor((math.log2(window) - bits) * window * UNIT + 1e-6)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, also where lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with code point offsets: array<struct<start,end,hit>>.

    Splitting by the pattern gives the gaps between the matches; offsets are running sums of both, taken
    in blocks so that a text with very many matches stays near linear.
    """
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def pieces(b: Column) -> Column:
        return F.zip_with(F.slice(b["gaps"], 1, F.size(b["hits"])), b["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), h.alias("hit")))

    def block(p: Column, start: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
        return F.aggregate(
            p,
            F.struct(start.alias("at"), none.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["len"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end"), x["hit"].alias("hit")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    def placed(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda i: F.slice(p, i * _BLOCK + 1, _BLOCK))
        def sums(bs: Column) -> Column:
            return F.aggregate(
                bs,
                F.array(F.lit(0)),
                lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.aggregate(x, F.lit(0), lambda s, y: s + y["gap"] + y["len"]))),
            )
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(sums(bs), 1, F.size(bs)), block)))

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(text.rlike(pattern), let(both, lambda b: let(pieces(b), placed))).otherwise(none)


def _runs(hit: Column, window: int, bits: dict[str, float], placeholder: str) -> Column:
    """Stretches of a candidate covered by windows of high entropy without a placeholder: array<struct<start,end>>."""
    weights = F.array(*[F.lit(w) for w in weight_table(window)])
    codes = F.transform(F.split(hit, "", -1), lambda c: F.ascii(c))
    codes = F.filter(codes, lambda c: c > 0)
    digit = lambda c: c.between(48, 57).cast("int")
    hexa = lambda c: (c.between(48, 57) | c.between(97, 102) | c.between(65, 70)).cast("int")
    letter = lambda c: (c.between(65, 90) | c.between(97, 122)).cast("int")

    def step(w: Column, cs: Column, a: Column, i: Column) -> Column:
        new = F.get(cs, i)
        old = F.when(i >= window, F.get(cs, i - window)).otherwise(F.lit(0))  # 0: nothing leaves yet
        # the counts of the two characters move by one; equal characters cancel out
        n_new = F.get(a["counts"], new - _FIRST_CODE) - (old == new).cast("int")
        n_old = F.when(old > 0, F.get(a["counts"], old - _FIRST_CODE)).otherwise(F.lit(0))
        total = a["total"] + F.when(old > 0, F.get(w, n_old - 1) - F.get(w, n_old)).otherwise(F.lit(0)) + F.get(w, n_new + 1) - F.get(w, n_new)
        moved = F.transform(a["counts"], lambda c, k: c + (k == new - _FIRST_CODE).cast("int") - (k == old - _FIRST_CODE).cast("int"))
        digits, hexes, letters = (a[n] + f(new) - f(old) for n, f in (("digits", digit), ("hexes", hexa), ("letters", letter)))
        full = (i + 1) >= window
        high = F.when(hexes == window, (total <= most_weight(window, bits["hex"])) & (digits >= 2) & (letters >= 1)).otherwise((total <= most_weight(window, bits["mixed"])) & (digits >= 2) & (letters >= 1))
        begin, end = (i + 1 - window).cast("int"), (i + 1).cast("int")
        last = F.get(a["runs"], F.size(a["runs"]) - 1)
        joined = F.concat(F.slice(a["runs"], 1, F.size(a["runs"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        begun = F.concat(a["runs"], F.array(F.struct(begin.alias("start"), end.alias("end"))))
        # looked for in windows of high entropy only
        runs = F.when(full & high & ~F.substring(hit, begin + 1, F.lit(window)).rlike(placeholder), F.when((F.size(a["runs"]) > 0) & (last["end"] >= begin), joined).otherwise(begun)).otherwise(a["runs"])
        return F.struct(moved.alias("counts"), total.alias("total"), digits.alias("digits"), hexes.alias("hexes"), letters.alias("letters"), runs.alias("runs"))

    zero = F.lit(0)
    start = F.struct(F.array_repeat(zero, _CODES).alias("counts"), zero.alias("total"), zero.alias("digits"), zero.alias("hexes"), zero.alias("letters"), F.array().cast(_RUNS).alias("runs"))
    return let(
        F.struct(weights.alias("w"), codes.alias("cs")),
        lambda v: F.aggregate(F.sequence(F.lit(0), F.size(v["cs"]) - 1), start, lambda a, i: step(v["w"], v["cs"], a, i), lambda a: a["runs"]),
    )


def entropy_spans(text: Column, window: int = WINDOW, bits: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW_LIST, placeholder: str = PLACEHOLDER) -> Column:
    """Spans of high sliding-window entropy off the allow-list; a placeholder hides the windows that hold it, not the rest of the candidate."""

    def wanted(x: Column) -> Column:
        ok = x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")
        for pattern in allow:
            ok = ok & ~x["hit"].rlike(pattern)
        return ok

    spans = F.flatten(
        F.transform(
            F.filter(located(text, CANDIDATE), wanted),
            lambda x: F.transform(_runs(x["hit"], window, bits or MIN_BITS, placeholder), lambda r: F.struct((x["start"] + r["start"]).alias("start"), F.lit(3).alias("ord"), (x["start"] + r["end"]).alias("end"), F.lit("entropy").alias("kind"))),
        )
    )
    return spans.cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns, sorted by start and then kind."""

    def typed(found: Column, kind: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("ord"), x["end"].alias("end"), F.lit(KINDS[kind]).alias("kind")))

    def assigned(x: Column) -> Column:
        return F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= ASSIGN_VALUE_MIN

    found = [typed(F.filter(located(text, ASSIGN), assigned), 0), typed(located(text, ACCESS), 1), typed(located(text, HEX), 2)]
    return F.array_sort(F.concat(*found).cast(_SPAN))


def scan(df: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW_LIST) -> DataFrame:
    """`df` with `secret_base` and `secret_spans`, arrays of struct<start,ord,end,kind> sorted by start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("secret_base", base_spans(t)).withColumn("secret_spans", F.array_sort(F.concat("secret_base", entropy_spans(t, allow=allow))))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`df` with every found span of `text` replaced by `mark`; overlapping spans are joined first.

    Null texts stay null. Columns and their order are kept.
    """
    columns = df.columns

    def merged(spans: Column) -> Column:
        return F.aggregate(
            spans,
            F.array().cast(_RUNS),
            lambda a, s: F.when(
                (F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= s["start"]),
                F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end")))),
            ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
        )

    def cut(runs: Column) -> Column:
        kept = F.transform(runs, lambda r, i: F.substring(F.col(text), F.when(i == 0, 1).otherwise(F.get(runs, i - 1)["end"] + 1), r["start"] - F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["end"])))
        tail = F.substring(F.col(text), F.get(runs, F.size(runs) - 1)["end"] + 1, F.lit(2**31 - 1))
        return F.array_join(F.concat(kept, F.array(tail)), mark)

    t = F.coalesce(F.col(text), F.lit(""))
    spans = F.array_sort(F.concat(base_spans(t), entropy_spans(t)))
    clean = let(spans, lambda s: F.when(F.size(s) > 0, let(merged(s), cut)).otherwise(F.col(text)))
    return df.withColumn(text, clean).select(*columns)


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns from the output of `scan`."""
    n = lambda k: F.size(F.filter("secret_base", lambda s: s["ord"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(as_text(F.col("secret_base")), 256).alias("base_sha256"),
        as_text(F.col("secret_spans")).alias("spans"),
    )
