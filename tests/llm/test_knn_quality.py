from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from lectern.llm import knn_quality as K
from lectern.llm.textwords import string_bytes


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    space = K.fit_on(docs, labels)
    rows = K.score(docs, space).join(labels, "doc_id").filter(K.held_out()).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    right = sum((r["score"] >= K.THRESHOLD) == (r["quality"] == 1) for r in rows)
    assert len(rows) > 30 and right >= 0.95 * len(rows)


def test_votes_equal_plain_cosines():
    r = np.random.default_rng(0)
    sample = [("".join(r.choice(list("ab ,.|!"), 80)), i % 2) for i in range(40)]
    space = K.fit(K.terms(*string_bytes(pa.array([t for t, _ in sample]))), np.array([y for _, y in sample]), rank=8)
    texts = ["".join(r.choice(list("ab ,.|!\n"), 60)) for _ in range(30)]
    x = K.terms(*string_bytes(pa.array(texts)))
    got = space.scores(x, np.ones(30), k=5)
    for i in range(30):
        z = (x[i] * space.weights) @ space.basis
        cosine = space.vectors @ (z / np.linalg.norm(z))
        near = sorted(range(40), key=lambda j: (-round(float(cosine[j]) * K.STEPS), j))[:5]
        w = np.maximum(cosine[near], 0).astype(float) ** K.SHARPNESS
        assert abs(got[i] - (w * space.labels[near]).sum() / w.sum()) < 1e-4


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a b c " * 9000, 0.5), (3, "a b c " * 9000, 0.5)], "doc_id int, text string, score double")
    labels = spark.createDataFrame([(1, 1)], "doc_id int, quality int")
    assert [r["score"] for r in K.score(docs, K.fit_on(docs, labels)).collect()] == [0.0] * 4
    fitted = K.fit(K.terms(*string_bytes(pa.array(["good words here.", "#### |||| ####"]))), np.array([1, 0]))
    got = [r["score"] for r in K.score(docs, fitted).orderBy("doc_id").collect()]
    assert got[:2] == [0.0, 0.0] and got[2] == got[3] > 0


def test_ties_go_to_the_first_of_the_sample_in_blocks_of_any_size(monkeypatch):
    texts = ["same words here"] * 6 + ["||| ### |||"] * 6
    labels = np.array([1, 0] * 6)
    x = K.terms(*string_bytes(pa.array(texts)))
    space = K.fit(x, labels)
    whole = space.scores(x, np.ones(12), k=3)
    monkeypatch.setattr(K, "BLOCK", 1)
    assert np.allclose(space.scores(x, np.ones(12), k=3), whole, atol=1e-5)
    assert np.allclose(whole[:6], 2 / 3, atol=1e-4)


def test_long_labelled_texts_take_part_in_the_fit(spark):
    docs = spark.createDataFrame([(i, ("good words and more of them. " if i % 2 else "||| ### $$$ ||| ") * 4000) for i in range(1, 30)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    space = K.fit_on(docs, labels)
    assert len(space.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 30))
