"""The divergence audit against plain Python with whole numbers."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from lectern.llm import divergence as D
from lectern.llm import queries as Q

SHOWN = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows: list[tuple]) -> list[tuple]:
    """rows of lang, source, text."""
    docs, counts, groups = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        g = (lang or "", source or "")
        groups.add(g)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[g].update(found)
        docs.update({(g[0], t) for t in found})
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (k, t), n in docs.items() if k == lang and n >= 3)
        mine = [g for g in groups if g[0] == lang]
        per = {g: {t: counts[g][t] for t in kept} for g in mine}
        whole = {t: sum(per[g][t] for g in mine) for t in kept}

        def share(c: dict, t: str, kept=kept) -> int:
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        p = {g: {t: share(per[g], t) for t in kept} for g in mine}
        q = {t: share(whole, t) for t in kept}
        for g in mine:
            pairs = [(sum((p[g][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h[1]) for h in mine if h != g]
            own = [((p[g][t] - q[t]) ** 2 // q[t], t) for t in kept if per[g][t] and p[g][t] > q[t]]
            for part, said, top in (("pair", pairs, None), ("term", own, 200)):
                said.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, i + 1) for i, (value, item) in enumerate(said[:top])]
    return sorted(out)


def texts(n: int, sources: int, words: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["w" + chr(97 + i % 26) + chr(97 + i // 26 % 26) + "é" * (i % 3) for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    out = []
    for _ in range(n):
        s = min(int(r.expovariate(0.5)), sources - 1)
        found = r.choices(vocabulary[s:] + vocabulary[:s], weights, k=r.randint(0, 60))
        out.append((r.choice(["en", "de"]), f"s{s}", "".join(w.title() + r.choice([" ", "-", "9", "\n", "日 "]) for w in found)))
    return out


ODD = [(None, None, None), ("", None, "a b c"), ("one", "only", "x x x"), ("none", "a", "1 2"), ("none", "b", None), ("en", "é", ""), ("en", None, "ǅ ÀÉ Straße"), ("en", "s0", "ǅ àé straße"), ("en", "s1", "ǅ ÀÉ"), ("en", "z", "wa " * 70_000)]
ODD += [("rep", "a", "same same"), ("rep", "a", "same same"), ("rep", "a", "same same"), ("rep", "b", "same")]


@pytest.mark.parametrize("slice_terms,tile", [(1024, 256), (40, 3), (100, 1)])
def test_against_whole_numbers(spark, slice_terms, tile):
    rows = texts(400, 9, 700, 5) + ODD
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(6)
    got = D.audit(df, slice_terms=slice_terms, tile=tile)
    assert got.columns == SHOWN and got.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_cells_and_large_counts():
    r = np.random.default_rng(3)
    counts = np.concatenate([r.integers(0, 4, (5, 150)), r.integers(0, 3, (5, 40)) * r.integers(1, 10**12, (5, 40))], axis=1)
    total = counts.sum(axis=1) + counts.shape[1]
    sets = collections.defaultdict(int)
    for g, t in np.argwhere(counts):
        sets[g, counts[g, t], t // 64] |= 1 << int(t % 64)
    source, count, word = (np.array(x, np.int64) for x in zip(*sets, strict=True))
    got = D.pair_values(source, count, word, np.array(list(sets.values()), np.uint64), total, counts.shape[1])
    p = [[1 + 10**9 * (int(c) + 1) // int(total[g]) for c in counts[g]] for g in range(5)]
    assert got.tolist() == [[sum((a - b) ** 2 // b for a, b in zip(p[g], p[h], strict=True)) for h in range(5)] for g in range(5)]


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_query(spark, sf):
    rows = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, Q.op11_source_divergence(spark, sf).select(*SHOWN).collect())) == brute(rows)
