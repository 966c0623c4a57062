"""Plain Python versions of the contracts, for small fixtures."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def quality(text: str | None) -> dict:
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": n < 10 or 100 * len(covered) > 20 * n}


def shingles(text: str | None, k: int = 3) -> frozenset:
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def components(docs: dict[int, str | None], k: int = 3, percent: int = 90) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, k) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def contamination(docs: dict[int, str | None], items: dict[str, str | None], span: int = 10) -> dict[int, tuple]:
    cut = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = {i: {tuple(w[j : j + min(len(w), span)]) for j in range(len(w) - min(len(w), span) + 1)} for i, t in items.items() if (w := cut(t))}
    out = {}
    for d, t in docs.items():
        words, hit, found = cut(t), set(), set()
        for i, ws in windows.items():
            n = len(next(iter(ws)))
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) in ws:
                    hit |= set(range(p, p + n))
                    found.add(i)
        out[d] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


SECRET_KINDS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    return sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(SECRET_KINDS) for m in p.finditer(text or "") if ok(m))
