from __future__ import annotations

import collections
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import piece_sampling as S
from lectern.llm.textwords import string_bytes

TEXTS = ["", "Hello world", "  two  spaces ", "tab\tand\nline\n\n", "▁ meta", "é日本語 😀 x", "a" * 300, "w" * 49 + " " + "no" * 24, " ", "\n", "naïve—dash…"]


@pytest.fixture(scope="module")
def vocabulary():
    return S.load()


def run(texts, v, keys=None, seed=0):
    keys = keys if keys is not None else list(range(len(texts)))
    ids, first = S.segment(*string_bytes(pa.array(texts)), S.key_hashes(pa.array(keys)), v, seed)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def test_decoding_is_lossless_for_odd_texts(vocabulary):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice(list("ab é\n\t ▁日😀Zz.,")) for _ in range(r.randint(0, 200))) for _ in range(200)]
    for seed in (0, 1):
        for t, ids in zip(texts, run(texts, vocabulary, seed=seed), strict=True):
            assert S.spell(np.array(ids, int), vocabulary).tobytes().decode() == t if ids else t == ""


def test_a_row_does_not_depend_on_its_neighbours(vocabulary):
    together = run(TEXTS, vocabulary)
    assert together == [run([t], vocabulary, [i])[0] for i, t in enumerate(TEXTS)]
    assert run(TEXTS[::-1], vocabulary, list(range(len(TEXTS)))[::-1]) == together[::-1]
    assert run(TEXTS, vocabulary, seed=5) != together


def paths(text, v):
    """Every segmentation of a text and its weight."""
    if not text:
        return {(): 1.0}
    out = collections.Counter()
    for n in range(1, min(16, len(text)) + 1):
        found = v.pieces.get(text[:n].replace(" ", "▁"))
        if found or n == 1:
            i, w = found or (S.BYTES, S.FALLBACK)
            ids = [i] if found else [v.first_byte + b for b in text[:1].encode()]
            for rest, x in paths(text[n:], v).items():
                out[(*ids, *rest)] += w * x
    return out


def test_frequencies_follow_path_weights(vocabulary):
    text, n = " thing", 40_000
    weights = paths(text, vocabulary)
    total = sum(weights.values())
    got = collections.Counter(map(tuple, run([text] * n, vocabulary)))
    assert set(got) <= set(weights)
    chi = sum((got[p] - n * w / total) ** 2 / (n * w / total) for p, w in weights.items() if n * w / total >= 5)
    cells = sum(n * w / total >= 5 for w in weights.values())
    assert chi < cells + 5 * math.sqrt(2 * cells)


@pytest.mark.parametrize("window", [2, 3, 4096])
def test_long_units_take_the_same_law(vocabulary, monkeypatch, window):
    text, n = "things", 4000
    monkeypatch.setattr(S, "WIDE", 0)
    monkeypatch.setattr(S, "WINDOW", window)
    weights = paths(text, vocabulary)
    total = sum(weights.values())
    got = collections.Counter(map(tuple, run([text] * n, vocabulary)))
    for p, w in weights.items():
        if n * w / total >= 20:
            assert abs(got[p] - n * w / total) < 6 * math.sqrt(n * w / total)


def test_long_units_draw_as_short_ones_do(vocabulary, monkeypatch):
    texts = ["thing " * 20, "é日本語" * 30, "a" * 2000, "x\r\ny;\r\n" * 50, "internationalisation" * 7]
    monkeypatch.setattr(S, "WIDE", 1 << 20)
    short = run(texts[:2] + texts[3:], vocabulary)
    monkeypatch.setattr(S, "WIDE", 0)
    for window in (5, 64):
        monkeypatch.setattr(S, "WINDOW", window)
        long = run(texts[:2] + texts[3:], vocabulary)
        assert short == long


def test_very_long_units(vocabulary):
    began = time.perf_counter()
    for text in ("a" * 100_000, "\u65e5" * 100_000, "ab" * 50_000):
        assert S.spell(np.array(run([text], vocabulary)[0], int), vocabulary).tobytes().decode() == text
    assert time.perf_counter() - began < 20


def test_pieces_with_control_characters_are_drawn(vocabulary):
    held = [(p, i) for p, (i, _) in vocabulary.pieces.items() if any(c < " " for c in p) and len(p) > 1]
    assert held
    for piece, i in held[:5]:
        text = piece.replace("▁", " ")
        assert any(i in ids for ids in run([text] * 3000, vocabulary)), repr(piece)


def test_pieces_of_any_length_take_part():
    long = "abcdefghijklmnopqrstuvwxyz"
    v = S.Vocabulary({long: (300, 0.03), "abc": (301, 0.3), **{c: (302 + k, 0.9) for k, c in enumerate(long)}}, 0, 400)
    found = run([long] * 200, v)
    assert [300] in found and any(len(f) > 1 for f in found)


def test_columns_named_like_results(spark, vocabulary):
    df = spark.createDataFrame([(1, "one two", 5, "x")], "doc_id long, text string, piece_ids int, decoded string")
    out = S.decode(S.encode(df, vocabulary), vocabulary)
    assert sorted(out.columns) == ["decoded", "doc_id", "piece_ids", "text"] and out.first()["decoded"] == "one two"


def test_tables(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.decode(S.encode(df, vocabulary), vocabulary).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    assert {r["doc_id"]: list(r["piece_ids"]) for r in got} == dict(enumerate([*run(TEXTS, vocabulary), []]))
    digests = S.digests(df, vocabulary).collect()
    assert all(r["lossless"] for r in digests) and len(digests) == len(rows)
    assert S.digests(df.limit(0), vocabulary).count() == 0
