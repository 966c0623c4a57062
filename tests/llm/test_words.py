"""Quality rules and decontamination against plain Python."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, quality_rules
from lectern.llm.textwords import string_bytes
from tests.llm import brute


def texts() -> list[str | None]:
    r = random.Random(5)
    vocab = ["alpha", "Beta", "gamma", "Ünder", "d#lta", "eps|lon", "zeta.", "42", "été", "a", "b*", "theta"]
    out: list[str | None] = [None, "", " ", "\n\n", "one", "a b c\n a b c\na b c", "x\ty\x0bz\x1cw v", "w " * 3000, "a b c d e f g h i j " * 40, "line one two\n" * 30]
    for _ in range(120):
        words = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        out.append("".join(w + r.choice([" ", " ", "  ", "\n", "\t"]) for w in words))
    return out + out[20:24]


def test_quality_counts(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = quality_rules.LineModel(quality_rules.DEFAULT_EMIT, quality_rules.DEFAULT_MOVE)
    got = {r["doc_id"]: r for r in quality_rules.judge(df, model).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        for k, v in brute.quality(t).items():
            assert got[i][k] == v, (i, k, t)
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(50):
        m = quality_rules.LineModel(r.normal(size=3), r.normal(size=(2, 2)))
        x = r.normal(size=(6, 3))
        e = x @ m.emit
        score = lambda p: sum(e[i] * s for i, s in enumerate(p)) + sum(m.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731,B023
        best = max(itertools.product((0, 1), repeat=6), key=score)
        assert score(tuple(m.labels(x, np.array([0, 6])).tolist())) == pytest.approx(score(best))


@pytest.fixture(scope="module")
def fitted(spark):
    """A model fitted without the held-out fifth, and that fifth judged, with labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality_rules.fit_on(docs, labels, allowed=~held)
    return model, quality_rules.judge(docs.filter(held), model).join(labels, "doc_id").filter("not base_failed").collect()


def test_held_out_documents(fitted):
    good, bad = ([r for r in fitted[1] if r["quality"] == q] for q in (1, 0))
    assert len(good) > 30 and len(bad) > 3
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.2 * len(bad)
    assert any(0 < r["content_share"] < 1 for r in bad)


def test_lines_are_labelled_one_by_one(spark, fitted, sf):
    import numpy as np

    model = fitted[0]
    prose = "The house on the hill was built by a man from the north, and his sons still live there with their wives."
    menu = " | ".join(["home", "news", "about", "login", "help", "terms", "shop", "cart"])
    shout = "BUY!! NOW!! CHEAP!! FREE!! BUY!! NOW!! CHEAP!! FREE!! BUY!! NOW!!"
    rows = [(1, "\n".join([prose + " " + w for w in "one two three four".split()] + [menu + " " + w for w in "one two three four".split()])), (2, "\n".join([shout, prose + " a", prose + " b"])), (3, "\n".join([menu, prose, menu + " x"])), (4, prose)]
    got = {r["doc_id"]: r["content_share"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    # four lines of 22 words of prose, four of 17 with bars (8 words, 8 bars, one more)
    assert got[1] == pytest.approx(4 * 22 / (4 * 22 + 4 * 16), abs=0.02) and 0 < got[2] < 1 and 0 < got[3] < 1 and got[4] == 1
    x = quality_rules.measure(*string_bytes(pa.array([rows[0][1]]))).features
    assert model.labels(x, np.array([0, len(x)])).tolist() == [1] * 4 + [0] * 4


def test_expected_shares_by_all_paths():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    score, move, real = r.normal(size=(2, 5, 2)), r.normal(size=(2, 2)), np.array([[True] * 5, [True] * 3 + [False] * 2])
    content, pairs = quality_rules._expected(score, move, real)
    for row, n in ((0, 5), (1, 3)):
        weights = {p: np.exp(sum(score[row, i, s] for i, s in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product((0, 1), repeat=n)}
        total = sum(weights.values())
        for i in range(n):
            assert content[row, i] == pytest.approx(sum(w for p, w in weights.items() if p[i]) / total)
        for i, a, b in itertools.product(range(n - 1), (0, 1), (0, 1)):
            assert pairs[row, i, a, b] == pytest.approx(sum(w for p, w in weights.items() if p[i : i + 2] == (a, b)) / total)
        assert not content[row, n:].any() and not pairs[row, n - 1 :].any()


def test_empty_tables_give_the_default_model(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept2 int")
    model = quality_rules.fit_on(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_rules.judge(docs, model).count() == 0


def contaminated_case():
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(60)] + ["É", "été"]
    items: dict[str, str | None] = {str(i): " ".join(r.choice(vocab) for _ in range(r.choice([3, 9, 10, 11, 25, 60]))) for i in range(30)}
    items |= {"null": None, "empty": "", "twin": items["4"]}
    docs: dict[int, str | None] = {0: None, 1: "", 2: "w1"}
    for d in range(3, 90):
        words = [r.choice(vocab) for _ in range(r.randint(0, 200))]
        for _ in range(r.randint(0, 3)):
            src = (items[str(r.randrange(30))] or "").upper().split()
            a = r.randrange(len(src))
            words[r.randint(0, len(words)) :] = src[a : a + r.randint(1, 30)]
        docs[d] = ", ".join(words)
    return docs, items


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_decontamination(spark, max_bytes):
    docs, items = contaminated_case()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(list(items.items()), "item_id string, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.digest_columns(decontaminate.find(d, b, max_bytes=max_bytes)).collect()}
    assert got == brute.contamination(docs, items)
    assert any(v[-1] for v in got.values())
    assert not any(r["contaminated"] for r in decontaminate.digest_columns(decontaminate.find(d, b.limit(0), max_bytes=max_bytes)).collect())
    assert decontaminate.find(d.limit(0), b, max_bytes=max_bytes).count() == 0


def test_both_ways_of_decontamination_agree(spark):
    passage = [f"p{i}" for i in range(40)]
    items = [(f"i{i}", " ".join(passage[: 10 + i])) for i in range(25)] + [("short", "x"), (None, "a b c"), ("twice", "u v w"), ("twice", " ".join(f"t{i}" for i in range(12)))]
    text = " ".join(["start", *passage[3:20], "mid", "a b c", *passage, "end"])
    docs = [(None, text, 1), (None, "nothing", 2), (7, "", 3), (8, "x", 4), (9, text, 5), (9, "u v w u v w", 6), (10, None, 7), (11, " ".join(passage[:9]), 8)]
    docs += [(12, " ".join(f"z{i % 977}" for i in range(200_000)) + " " + " ".join(passage), 9), (9, text, 10), (9, text, 11)]
    d = spark.createDataFrame(docs, "doc_id long, text string, __n int").coalesce(1)
    b = spark.createDataFrame(items, "item_id string, text string")
    broadcast, exchanged = ({r["__n"]: r for r in decontaminate.find(d, b, max_bytes=m, carry=d.columns).collect()} for m in (1 << 20, 0))
    assert len(exchanged) == len(docs) and exchanged == broadcast
    assert exchanged[1]["n_hit"] > 50 and exchanged[4]["items"] == ["short"] and exchanged[9]["n_hit"] == 34
    assert exchanged[10]["n_hit"] == exchanged[11]["n_hit"] == exchanged[5]["n_hit"]
