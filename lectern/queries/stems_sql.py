"""DuckDB SQL of the stemming rules and of cover density: steps over a table of distinct words, and windows over occurrences."""

from __future__ import annotations

from collections.abc import Mapping

from lectern.functions import stemming as S


def _list(chars: str) -> str:
    return ", ".join(f"'{c}'" for c in chars)


def _any(known: Mapping[str, object]) -> str:
    return "(" + "|".join(known) + ")$"


def _new(cut: str, known: Mapping[str, str]) -> str:
    by_new: dict[str, list[str]] = {}
    for suffix, new in known.items():
        by_new.setdefault(new, []).append(suffix)
    return f"CASE {' '.join(f'''WHEN {cut} IN ({', '.join(repr(x) for x in xs)}) THEN '{new}' ''' for new, xs in by_new.items())}ELSE '' END"


def romanian(words: str, name: str) -> str:
    """CTEs that end with `name`(w, s): the stem of every word w of the relation `words`."""
    v = _list(S.RO_VOWELS)
    articles, combined, derived = (S.classes(x) for x in (S.RO_ARTICLES, S.RO_COMBINED, S.RO_DERIVED))
    after = dict.fromkeys(S.RO_VERBS_AFTER_CONSONANT.split())
    verbs = after | dict.fromkeys(S.RO_VERBS.split())
    rv, r1, r2 = S.region_patterns(S.RO_VOWELS)
    semi = f"list_reduce(list_concat([''], list_transform(range(1, length(w) + 1), lambda i: substr(w, i::INT, 2))), lambda a, p: a || CASE WHEN p[1:1] IN ('u', 'i') AND right(a, 1) IN ({v}) AND p[2:2] IN ({v}) THEN upper(p[1:1]) ELSE p[1:1] END)"
    begin = lambda p: f"CASE WHEN regexp_matches(u, '{p}') THEN length(regexp_extract(u, '{p}')) ELSE length(u) END"
    stem = "left(u, length(u) - length(cut))"
    steps = [
        f"{name}_a AS (SELECT *, {begin(rv)} AS rv, {begin(r1)} AS r1, {begin(r2)} AS r2 FROM (SELECT w, {semi} AS u FROM (SELECT DISTINCT w FROM {words})))",
        f"{name}_0 AS (SELECT * REPLACE (CASE WHEN cut <> '' AND length(u) - length(cut) >= r1 AND NOT (cut = 'ile' AND {stem} LIKE '%ab') THEN {stem} || {_new('cut', articles)} ELSE u END AS u), false AS done FROM (SELECT *, regexp_extract(u, '{_any(articles)}') AS cut FROM {name}_a))",
    ]
    for i in range(4):  # no word of the tables has more of these suffixes
        hit = "cut <> '' AND length(u) - length(cut) >= r1"
        steps.append(f"{name}_{i + 1} AS (SELECT * EXCLUDE cut REPLACE (CASE WHEN {hit} THEN {stem} || {_new('cut', combined)} ELSE u END AS u, done OR {hit} AS done) FROM (SELECT * {'EXCLUDE cut' if not i else ''}, regexp_extract(u, '{_any(combined)}') AS cut FROM {name}_{i}))")
    hit = f"cut <> '' AND length(u) - length(cut) >= r2 AND (cut NOT IN ('iune', 'iuni') OR {stem} LIKE '%ț')"
    steps += [
        f"{name}_5 AS (SELECT * REPLACE (CASE WHEN {hit} THEN CASE WHEN cut IN ('iune', 'iuni') THEN left(u, length(u) - 5) || 't' ELSE {stem} || {_new('cut', derived)} END ELSE u END AS u, done OR ({hit}) AS done) FROM (SELECT *, regexp_extract(u, '{_any(derived)}') AS cut FROM {name}_4))",
        f"{name}_6 AS (SELECT *, substr(u, rv + 1) AS inr, regexp_extract(substr(u, rv + 1), '{_any(verbs)}') AS suf FROM {name}_5)",
        f"{name}_7 AS (SELECT w, rv, CASE WHEN NOT done AND suf <> '' AND (suf NOT IN ({', '.join(map(repr, after))}) OR (length(inr) > length(suf) AND inr[length(inr) - length(suf)] NOT IN ({_list(S.RO_VOWELS.replace('u', ''))}))) THEN left(u, length(u) - length(suf)) ELSE u END AS u FROM {name}_6)",
        f"{name} AS (SELECT w, lower(CASE WHEN cut <> '' AND length(u) - length(cut) >= rv THEN {stem} ELSE u END) AS s FROM (SELECT *, regexp_extract(u, '{_any(dict.fromkeys(S.RO_ENDINGS.split()))}') AS cut FROM {name}_7))",
    ]
    return ",\n".join(steps)


def russian(words: str, name: str) -> str:
    """CTEs that end with `name`(w, s), as for Romanian."""
    v = S.RU_VOWELS

    def without(step: str, before: str, some: str, any_: str, where: str = "true") -> list[str]:
        """Table `step` with x shortened by a suffix of `any_`, or of `some` after а or я, and whether it was."""
        known = (some + " " + any_).split()
        asked = f"cut NOT IN ({', '.join(map(repr, some.split()))}) OR right(left(x, length(x) - length(cut)), 1) IN ('а', 'я')" if some else "true"
        return [f"{step} AS (SELECT * EXCLUDE (cut, hit) REPLACE (CASE WHEN hit THEN left(x, length(x) - length(cut)) ELSE x END AS x), hit AS hit FROM (SELECT *, cut <> '' AND ({asked}) AND ({where}) AS hit FROM (SELECT * {'EXCLUDE hit' if before != f'{name}_a' else ''}, regexp_extract(x, '{_any(dict.fromkeys(known))}') AS cut FROM {before})))"]

    n = name
    steps = [f"{n}_a AS (SELECT w, regexp_extract(w, '^[^{v}]*[{v}]') AS head, CASE WHEN regexp_matches(w, '[{v}]') THEN substr(w, length(regexp_extract(w, '^[^{v}]*[{v}]')) + 1) ELSE '' END AS x FROM (SELECT DISTINCT w FROM {words}))"]
    steps += without(f"{n}_g", f"{n}_a", S.RU_GERUNDS_AFTER_A, S.RU_GERUNDS)
    steps.append(f"{n}_h AS (SELECT * EXCLUDE hit, hit AS gerund, hit FROM {n}_g)")
    steps += without(f"{n}_r", f"{n}_h", "", S.RU_REFLEXIVES, "NOT gerund")
    steps += without(f"{n}_j", f"{n}_r", "", S.RU_ADJECTIVES, "NOT gerund")
    steps.append(f"{n}_k AS (SELECT * EXCLUDE hit, hit AS adj, hit FROM {n}_j)")
    steps += without(f"{n}_p", f"{n}_k", S.RU_PARTICIPLES_AFTER_A, S.RU_PARTICIPLES, "adj")
    steps += without(f"{n}_v", f"{n}_p", S.RU_VERBS_AFTER_A, S.RU_VERBS, "NOT gerund AND NOT adj")
    steps.append(f"{n}_w AS (SELECT * EXCLUDE hit, hit AS verb, hit FROM {n}_v)")
    steps += without(f"{n}_n", f"{n}_w", "", S.RU_NOUNS, "NOT gerund AND NOT adj AND NOT verb")
    r2 = f"^[^{v}]*[{v}]+[^{v}]+[{v}]+[^{v}]"
    steps += [
        f"{n}_i AS (SELECT w, head, CASE WHEN right(x, 1) = 'и' THEN left(x, length(x) - 1) ELSE x END AS x, CASE WHEN regexp_matches(w, '{r2}') THEN length(regexp_extract(w, '{r2}')) ELSE length(w) END AS r2 FROM {n}_n)",
        f"{n}_d AS (SELECT w, head, CASE WHEN cut <> '' AND length(head) + length(x) - length(cut) >= r2 THEN left(x, length(x) - length(cut)) ELSE x END AS x FROM (SELECT *, regexp_extract(x, '(ост|ость)$') AS cut FROM {n}_i))",
        f"{n}_t AS (SELECT w, head, regexp_matches(x, '(ейш|ейше)$') AS sup, CASE WHEN regexp_matches(x, '(ейш|ейше)$') THEN regexp_replace(x, '(ейше|ейш)$', '') WHEN right(x, 1) = 'ь' THEN left(x, length(x) - 1) ELSE x END AS y, x FROM {n}_d)",
        f"{n} AS (SELECT w, CASE WHEN head = '' THEN w ELSE head || CASE WHEN right(y, 2) = 'нн' AND right(x, 1) <> 'ь' THEN left(y, length(y) - 1) ELSE y END END AS s FROM {n}_t)",
    ]
    return ",\n".join(steps)


#: A text as the index reads it, of Latin and ASCII characters, and its words.
WORDS = r"regexp_extract_all(lower(replace(strip_accents({}), 'ß', 'ss')), '[\p{{L}}\p{{N}}_]+')"


def density(tokens: str, alternatives: str, by: str) -> str:
    """CTE `found`: `by`, item_id, terms and covers. tokens has `by`, pos and s; alternatives has item_id, term, j (from 0), word and n (words of the term)."""
    return f"""
occ AS (SELECT {by}, item_id, term, pos - j AS b, pos - j + n - 1 AS e FROM {tokens} JOIN {alternatives} ON s = word GROUP BY {by}, item_id, term, pos - j, n HAVING count(*) = n),
placed AS (SELECT *, max(b) OVER (PARTITION BY {by}, item_id ORDER BY e, b DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM occ),
found AS (SELECT {by}, item_id, count(DISTINCT term) AS terms, count(*) FILTER (last IS NULL OR b > last) AS covers FROM placed GROUP BY {by}, item_id)"""
