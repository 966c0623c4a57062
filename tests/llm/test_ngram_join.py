"""The join against all pairs."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from lectern.llm import ngram_join as J
from lectern.llm.components import components
from lectern.session import shared_dir
from tests.llm import brute


def copies(seed: int = 3) -> dict[int, str | None]:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Ünder", "A", "a"]
    out: dict[int, str | None] = {0: None, 1: "", 2: " \n", 3: "one", 4: "ONE", 5: "one two", 6: "One  two\n", 7: "a b c"}
    passage = [r.choice(vocab) for _ in range(40)]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([8, 20, 60, 150, 400]))]
        if r.random() < 0.4:
            base = passage + base
        now = base
        for _ in range(r.randint(1, 9)):
            now = list(now) if r.random() < 0.5 else list(base)  # chains and stars
            for _ in range(r.randint(0, max(1, len(now) // 45))):
                at = r.randrange(len(now))
                now[at : at + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 2)
            out[len(out)] = r.choice([" ", "\n", "  "]).join(now)
    return out


@pytest.mark.parametrize("k,percent,tile", [(3, 90, 10**6), (5, 80, 10**6), (3, 90, 300), (5, 80, 700)])
def test_against_all_pairs(spark, k, percent, tile):
    docs = copies()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in J.link_groups(df, J.Rule(k, percent), tile_shingles=tile).collect()}
    assert got == brute.components(docs, k, percent)


def test_blocking_misses_no_linked_pair():
    r = np.random.default_rng(2)
    for k, percent in ((3, 90), (5, 80)):
        rule = J.Rule(k, percent)
        bounds = rule.class_bounds(1 << 14)
        for _ in range(400):
            n = int(r.choice([1, 2, 5, 9, 10, 12, 19, 30, 31, 47, 100, 333, 1500]))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            d = (100 - percent) * 2 * len(a) // (100 + percent)
            gone = int(r.integers(0, d + 1))
            b = np.unique(np.concatenate([a[gone:], r.integers(0, 2**63, d - gone).astype(np.uint64)]))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(J.part_keys(a, rule, bounds), J.part_keys(b, rule, bounds)))


def test_extra_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 5), (1, "a b c d e f g", 6), (9, "A b c d e f g", 7)], "doc_id int, text string, component_id int")
    assert sorted(map(tuple, J.link_groups(df, J.Rule()).collect())) == [(1, 3, 1), (1, 3, 1), (9, 3, 1)]
    assert J.link_groups(df.limit(0), J.Rule()).count() == 0


def test_ids_on_different_texts(spark):
    long, other = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(5, long), (5, other), (5, None), (9, long + " z"), (7, other), (2, other + " y"), (8, "x"), (None, long), (None, "alone here now")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = sorted((r[0] or -1, r[1], r[2] if r[2] is not None else -1) for r in J.link_groups(df, J.Rule(3, 80)).collect())
    assert got == sorted([(5, 10, 5), (5, 10, 2), (5, 0, 5), (9, 11, 5), (7, 10, 2), (2, 11, 2), (8, 1, 8), (-1, 10, 5), (-1, 1, -1)])


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("n,times", [(4, 20_000), (12, 20_000), (18, 5000), (400, 800), (1499, 200), (1501, 200)])
def test_unrelated_sets_share_no_key(k, percent, n, times):
    r = np.random.default_rng(n)
    rule = J.Rule(k, percent)
    bounds = rule.class_bounds(1 << 14)
    keys = np.concatenate([J.part_keys(np.unique(r.integers(0, 2**64, n, np.uint64)), rule, bounds) for _ in range(times)])
    assert len(np.unique(keys)) == len(keys)


def test_unlinked_short_texts_make_no_pairs_of_tiles(spark):
    from pathlib import Path

    from lectern.session import shared_dir

    r = random.Random(6)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(16))) for i in range(20_000)]
    base = Path(shared_dir(spark).removeprefix("file://"))
    before = set(base.glob("ngram-join-*"))
    got = J.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), J.Rule(5, 80), tile_sets=64)
    assert got.filter("component_id <> doc_id").count() == 0
    (folder,) = set(base.glob("ngram-join-*")) - before
    assert not (folder / "many").exists() and spark.read.parquet(f"file://{folder}/shared").count() == 0 == spark.read.parquet(f"file://{folder}/members").count()


def test_a_small_edge_table_is_settled_in_one_pass(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(300)]
    edges = [*chain, *((int(a), int(b)) for a, b in rng.integers(-400, 2000, (900, 2)) if a < -1 or a > 301 and b > 301), (-5, -5)]
    df = spark.createDataFrame(edges, "a int, b int").repartition(4)
    folder = Path(shared_dir(spark).removeprefix("file://"))
    steps = lambda: len(list(folder.glob("*/rdd-*")))
    before = steps()
    got = {(r["node"], r["root"]) for r in components(df, "a", "b").collect()}
    assert steps() - before <= 2
    assert got == {(r["node"], r["root"]) for r in components(df, "a", "b", few=0).collect()}  # by steps
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(root)):
        old = dict(root)
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if root == old:
            break
    assert got == set(root.items())
