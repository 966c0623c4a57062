"""The mix against plain Python: targets, networks by exhaustive search, whole selections."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing as M
from lectern.llm import queries as Q


def words(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(sizes: dict) -> dict:
    """Targets by filling all sources to a level that rises until the whole is out."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    """rows of doc_id, text, source, each in its one source."""
    sizes: dict = collections.Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    target, out = wanted(sizes), []
    for s in sizes:
        mine = collections.defaultdict(list)
        for i, text, source in rows:
            if source == s:
                seed = hashlib.md5(f"mix:{'' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()[:15]
                mine[int(seed, 16)].append((i, words(text)))
        flow = int(target[s] + 0.5)
        passes, rest = divmod(flow, sizes[s]) if sizes[s] else (0, 0)
        for seed in sorted(mine):
            here = sum(n for _, n in mine[seed])
            for i, n in mine[seed]:
                more = n if here <= rest else (2 * max(rest, 0) * n + here) // (2 * here)
                out.append((i, n, sizes[s], round(target[s], 6), passes * n + more))
            rest -= here
    return sorted(out, key=repr)


def found(df, **more) -> list[tuple]:
    return sorted([(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in M.mix(df, **more).collect()], key=repr)


def table() -> list[tuple]:
    r = random.Random(11)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(int(r.paretovariate(0.9) * 4) % 3000)), r.choice(["a", "b", "é", "a", "a", "z", None])) for i in range(500)]
    rows += [(None, "no key here", "b"), (3, "", "empty"), (4, None, "empty"), (5, "one", "tiny"), (6, "x " * 200_000, "long"), (7, "again and again", "a"), (7, "other text", "a")]
    return rows + [(8, "the very same row", "same")] * 40


def test_against_plain_python(spark):
    rows = table()
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size int, _size int").repartition(7)
    got = found(df)
    assert got == brute(rows) == found(df.repartition(3))
    by_source = {(x[2], x[3]): [0, 0] for x in got}
    for x in got:
        by_source[x[2], x[3]][0] += x[4]
        by_source[x[2], x[3]][1] += 1
        assert 0 <= x[4] <= 2 * x[1]
    assert all(abs(n - target) <= 1 or rows_ == 40 and abs(n - target) <= 40 for (_, target), (n, rows_) in by_source.items())


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert found(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")) == [(1, 0, 0, 0.0, 0)]


def cheapest(sizes: list[int], members: list[list[int]], quotas: list[int]) -> tuple[int, int]:
    """(words met, cost) by trying every split of every pattern's flow."""
    best = (0, 0)
    ways = []
    for n, m in zip(sizes, members, strict=True):
        ways.append([w for w in itertools.product(*[range(min(quotas[j], 2 * n) + 1) for j in m]) if sum(w) <= 2 * n])
    for pick in itertools.product(*ways):
        got, cost = [0] * len(quotas), 0
        for w, m, n in zip(pick, members, sizes, strict=True):
            for j, x in zip(m, w, strict=True):
                got[j] += x
            cost += sum(w) + max(0, sum(w) - n)
        if all(g <= q for g, q in zip(got, quotas, strict=True)):
            best = min(best, (-sum(got), cost))
    return -best[0], best[1]


def test_networks_by_exhaustive_search():
    r = random.Random(2)
    for _ in range(60):
        k = r.randint(1, 3)
        members = [sorted(r.sample(range(k), r.randint(1, min(2, k)))) for _ in range(3)]
        sizes, quotas = [r.randint(0, 3) for _ in members], [r.randint(0, 4) for _ in range(k)]
        flow = M.min_cost_flow(sizes, members, quotas, 2)
        out = [sum(n for (i, _), n in flow.items() if i == p) for p in range(3)]
        into = [sum(n for (_, j), n in flow.items() if j == s) for s in range(k)]
        assert all(n > 0 and j in members[i] for (i, j), n in flow.items())
        assert all(a <= 2 * b for a, b in zip(out, sizes, strict=True)) and all(a <= b for a, b in zip(into, quotas, strict=True))
        assert (sum(out), sum(x + max(0, x - n) for x, n in zip(out, sizes, strict=True))) == cheapest(sizes, members, quotas)


def test_overlapping_sources(spark):
    """What two sources share is taken once for both before anything is taken twice."""
    rows = [(i, "w " * 10, "a" if i < 40 else "b", ["=a"] if i < 20 else ["=a", "=b"] if i < 60 else ["=b"]) for i in range(80)] + [(100 + i, "w w", "c", ["=c"]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, members array<string>")
    docs = M.sized(df, F.col("members"), carry=["doc_id"])
    quotas = spark.createDataFrame([("=a", 300.0), ("=b", 300.0), ("=c", 15.0)], "_source string, target double")
    flow = {tuple(r["_pattern"]): (r["words"], r["_flow"]) for r in M.flows(docs, quotas).collect()}
    assert flow[("=a", "=b")] == (400, 400) and flow[("=a",)][1] + flow[("=b",)][1] == 200 and flow[("=c",)] == (10, 15)
    taken = collections.Counter()
    for r in M.selected(docs, M.flows(docs, quotas)).collect():
        taken[tuple(r["_pattern"])] += r["taken"]
        assert r["taken"] <= 2 * r["_size"]
    assert taken == {k: n for k, (_, n) in flow.items()}


@pytest.mark.parametrize("sizes", [[1], [0, 0], [10, 10, 10], [1, 1000, 3, 5, 100, 2, 900, 0], list(range(60))])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"=s{i:03}", n) for i, n in enumerate(sizes)], "_source string, size long")
    got = {r["_source"]: r["target"] for r in M.targets(df).collect()}
    assert got == pytest.approx(wanted({f"=s{i:03}": n for i, n in enumerate(sizes)}))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes))


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted([(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in Q.op12_source_mix(spark, sf).collect()], key=repr) == brute(rows)
