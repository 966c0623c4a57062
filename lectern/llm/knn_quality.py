"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words (lower-cased, hashed into WORD_TERMS places), pairs of neighbouring character classes and a few counts of repetition. A bounded
sample of labelled documents gives the inverse document frequencies, a truncated singular value decomposition and the labelled vectors, which are
broadcast (their size is bounded by the sample). Every document is folded in and its cosines with all labelled vectors
are taken exactly, in blocks; the nearest ones vote with weights that grow with similarity.

Defined results: null and empty texts have a zero vector and score 0; without labels of both kinds every score is 0; repeated rows
and equal texts score alike; cosines count in steps of 1e-6, and of labelled vectors at the same step the first of the sample is the nearest; an empty
table gives no rows; other columns are not read. Labels, languages, sources and ids are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.quality_rules import measure
from lectern.llm.samples import MAX_DOCS_PER_LABEL, labelled_sample
from lectern.llm.textwords import SPACED, chunks, words_of

RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8
THRESHOLD = 0.3
FOLDS = 5
BLOCK = 1024
STEPS = 1_000_000

# classes: every ASCII punctuation mark for itself, and kinds of the other bytes
CLASS = np.zeros(256, np.int64)
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
for _i, _b in enumerate(_marks):
    CLASS[_b] = 10 + _i
CLASS[32], CLASS[10], CLASS[[9, 11, 12, 13]] = 1, 2, 3
CLASS[48:58], CLASS[65:91], CLASS[97:123] = 4, 5, 6
CLASS[[ord(c) for c in "aeiou"]] = 7
CLASS[128:192], CLASS[192:] = 8, 9
CLASSES = 10 + len(_marks)
EXTRA = 6
WORD_TERMS = 1024
#: What the words weigh in the squared length of a document's terms, against 1 for the pairs of classes.
WORD_WEIGHT = 1.0
TERMS = WORD_TERMS + CLASSES * CLASSES + EXTRA


def terms(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Root of the relative frequency of every term, one row a text."""
    n = len(offs) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(buf) > 1:
        c = CLASS[buf]
        text = np.repeat(np.arange(n), np.diff(offs))
        inside = text[1:] == text[:-1]
        at = (text[:-1] * (CLASSES * CLASSES) + c[:-1] * CLASSES + c[1:])[inside]
        pairs = out[:, WORD_TERMS:-EXTRA]
        pairs += np.bincount(at, minlength=n * CLASSES * CLASSES).reshape(n, -1)
        pairs /= np.maximum(np.diff(offs) - 1, 1)[:, None]
        found = words_of(buf, offs, SPACED)
        at = found.text_of * WORD_TERMS + (found.hash % np.uint64(WORD_TERMS)).astype(np.int64)
        words = out[:, :WORD_TERMS]
        words += np.bincount(at, minlength=n * WORD_TERMS).reshape(n, -1)
        words *= WORD_WEIGHT / np.maximum(found.counts, 1)[:, None]
    m = measure(buf, offs)
    words = np.maximum(m.n_words, 1)
    lines = np.maximum(np.diff(m.first_line), 1)
    owner = np.repeat(np.arange(n), np.diff(m.first_line))
    within = np.bincount(owner, m.features[:, 9] * m.line_words, minlength=n)
    out[:, -EXTRA:] = np.stack([m.n_repeat_words / words, m.n_dup_lines / lines, within / words, m.word_chars / words / 40, lines / words, 1 / words], 1)
    return np.sqrt(out, out=out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Space:
    weights: np.ndarray  # of the terms
    basis: np.ndarray  # terms by rank
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray

    def fold(self, x: np.ndarray) -> np.ndarray:
        return unit((x * self.weights) @ self.basis)

    def scores(self, x: np.ndarray, words: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        out = np.zeros(len(x))
        if not len(self.labels):
            return out
        k = min(k, len(self.labels))
        z = self.fold(x)
        for a in range(0, len(x), BLOCK):
            cosine = z[a : a + BLOCK] @ self.vectors.T
            # one number for step and place, so that no two are equal
            ranks = np.rint(cosine * STEPS).astype(np.int64) * len(self.labels) - np.arange(len(self.labels))
            near = np.argpartition(-ranks, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (len(cosine), 1))
            near.sort(axis=1)
            weight = np.maximum(np.rint(np.take_along_axis(cosine, near, 1) * STEPS) / STEPS, 0) ** SHARPNESS
            out[a : a + BLOCK] = (weight * self.labels[near]).sum(1) / np.maximum(weight.sum(1), 1e-12)
        return np.clip(np.where(words > 0, out, 0.0), 0, 1)


def fit(x: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Space:
    """From the terms and labels of the sample."""
    if len(set(labels.tolist())) < 2:
        return Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    seen = (x > 0).sum(0)
    weights = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
    weighted = x * weights
    # right singular vectors from the smaller Gram matrix
    used = np.flatnonzero(seen)
    if len(used) <= len(x):
        values, vectors = np.linalg.eigh((weighted[:, used].T @ weighted[:, used]).astype(np.float64))
        right = vectors[:, ::-1][:, :rank]
    else:
        values, vectors = np.linalg.eigh((weighted @ weighted.T).astype(np.float64))
        right = weighted[:, used].T @ vectors[:, ::-1][:, :rank]
        right = right[:, values[::-1][:rank] > 1e-9 * max(values[-1], 1e-30)]
    basis = np.zeros((TERMS, right.shape[1]), np.float32)
    basis[used] = unit(right.T).T
    return Space(weights, basis, unit(weighted @ basis).astype(np.float32), labels.astype(float))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS_PER_LABEL) -> Space:
    """Fitted on at most 2 * max_docs labelled documents outside the held-out fold; their terms are counted in tasks and collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text):
            rows = terms(buf, offs)
            places = [np.flatnonzero(r) for r in rows]
            ends = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32))
            used = np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.float32), *(r[p] for r, p in zip(rows, places, strict=True))])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(used)), pa.ListArray.from_arrays(ends, pa.array(values, pa.float32()))], ["_n", "_label", "_at", "_terms"])

    sample = labelled_sample(docs, labels, "quality", key, text, max_docs, ~held_out(key)).mapInArrow(run, "_n int, _label int, _at array<int>, _terms array<float>").toArrow().sort_by([("_label", "ascending"), ("_n", "ascending")])
    x = np.zeros((sample.num_rows, TERMS), np.float32)
    for i, (at, values) in enumerate(zip(sample["_at"], sample["_terms"], strict=True)):
        x[i, np.asarray(at.values)] = np.asarray(values.values)
    return fit(x, sample["_label"].to_numpy())


def score(docs: DataFrame, space: Space, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, from 0 to 1, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text):
            scores = shared.value.scores(terms(buf, offs), np.diff(offs))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), pa.array(scores, pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")
