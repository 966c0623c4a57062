"""Quality rules with a line model.

Counting rules reject very short and self-repeating documents. Of the others, a linear-chain conditional random
field labels every line as content or boilerplate by Viterbi decoding, and the share of words in
content lines decides. The field is fitted on a bounded sample of labelled documents; their labels are only a weak hint at those of
their lines, see `fit`. Without labels of both kinds the stated DEFAULT weights hold.

Defined results: null and empty texts have no words and fail the base rule; repeated rows are treated alike; on equal scores of two paths a line
is content; lines without a word carry no label; an empty table gives no rows; other columns are kept, except those with the name of a result.
Texts are read whole; memory is bounded by a chunk of texts, or by one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from lectern.llm.samples import labelled_sample
from lectern.llm.textwords import SPACED, chunks, mixed, string_bytes, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
MIN_CONTENT_SHARE = 0.5
#: Bound of the fit, documents of each label, and what the label of a document adds to the log odds of its lines there.
MAX_DOCS = 1000
WEAK = 0.7
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*COUNTS, "base_failed", "content_share", "kept"]

LINE = np.ones(256, dtype=bool)
LINE[10] = False
_is = lambda chars: np.isin(np.arange(256), list(chars.encode()))
SYMBOL, PIPE, DIGIT, BANG, STOP = _is("#*$%&|<>"), _is("|"), _is("0123456789"), _is("!?"), _is(".,;:")
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
HEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of characters

FEATURES = ("bias", "symbols", "pipes", "digits", "marks", "upper", "letters", "log words", "word length", "repeats", "earlier", "stops")
#: States: 0 boilerplate, 1 content.
DEFAULT_EMIT = np.array([0.5, -12.0, -12.0, -4.0, -12.0, -6.0, 1.5, 0.3, -0.05, -4.0, -2.0, 2.0])
DEFAULT_MOVE = np.array([[0.7, -0.7], [-0.7, 0.7]])


@dataclass
class LineModel:
    emit: np.ndarray  # weights of content against boilerplate
    move: np.ndarray  # scores of neighbouring states

    def labels(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best state sequence of each text's lines; `first`: of each text its first line, and the end."""
        scores = (features @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        out = np.zeros(len(scores), np.int8)
        bounds = first.tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            v0, v1, back = 0.0, scores[a], []
            for s in scores[a + 1 : b]:
                from0, from1 = v1 + m10 > v0 + m00, v1 + m11 >= v0 + m01
                back.append((from0, from1))
                v0, v1 = (v1 + m10 if from0 else v0 + m00), (v1 + m11 if from1 else v0 + m01) + s
            state = int(v1 >= v0)
            out[b - 1] = state
            for i in range(b - a - 2, -1, -1):
                state = int(back[i][state])
                out[a + i] = state
        return out


@dataclass
class Measured:
    """Counts of each text, and features of each line that has a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray
    line_words: np.ndarray
    first_line: np.ndarray


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def measure(buf: np.ndarray, offs: np.ndarray) -> Measured:
    words = words_of(buf, offs, SPACED, lower=False)
    lines = words_of(buf, offs, LINE, lower=False)
    mask = SPACED[buf]
    in_words, symbols = _running(mask & HEAD[buf]), _running(SYMBOL[buf])
    per_text = lambda r: r[offs[1:]] - r[offs[:-1]]

    # words in windows found twice or more in the text
    marks = np.zeros(len(words.hash) + 1, np.int64)
    g = words.grams(REPEAT_WINDOW)
    text_of = words.text_of
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.hash))
    at = np.flatnonzero(left[: len(g)] >= REPEAT_WINDOW)
    if len(at):
        _, inverse, n = np.unique(g[at] ^ mixed(text_of[at].astype(np.uint64)), return_inverse=True, return_counts=True)
        twice = at[n[inverse] > 1]
        np.add.at(marks, twice, 1)
        np.add.at(marks, twice + REPEAT_WINDOW, -1)
    repeated = _running(np.cumsum(marks)[:-1] > 0)

    # lines with a word; equal ones are counted but for the first
    kept = np.flatnonzero(_running(mask)[lines.end] > _running(mask)[lines.start]) if len(lines.start) else np.zeros(0, np.int64)
    line_text = lines.text_of[kept]
    start, end = lines.start[kept], lines.end[kept]
    n_texts = len(offs) - 1
    earlier = np.ones(len(kept), bool)
    if len(kept):
        _, firsts = np.unique(lines.hash[kept] ^ mixed(line_text.astype(np.uint64)), return_index=True)
        earlier[firsts] = False
    dup = np.bincount(line_text[earlier], minlength=n_texts)

    line_first = np.searchsorted(line_text, np.arange(n_texts + 1))
    w0, w1 = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    n = np.maximum(w1 - w0, 1)
    chars = np.maximum(in_words[end] - in_words[start], 1)
    within = lambda table: (lambda r: r[end] - r[start])(_running(table[buf]))
    same = np.zeros(len(words.hash), bool)
    if len(words.hash):
        line_of = np.repeat(np.arange(len(kept)), w1 - w0)
        _, f = np.unique(words.hash ^ mixed(line_of.astype(np.uint64)), return_index=True)
        same[:] = True
        same[f] = False
    again = _running(same)
    letters = np.maximum(within(LETTER), 1)
    features = np.stack(
        [np.ones(len(kept)), (symbols[end] - symbols[start]) / chars, within(PIPE) / n, within(DIGIT) / chars, within(BANG) / n, within(UPPER) / letters, letters / chars, np.log1p(w1 - w0), chars / n, (again[w1] - again[w0]) / n, earlier.astype(float), within(STOP) / n], 1
    ).reshape(len(kept), len(FEATURES))
    return Measured(words.counts, per_text(in_words), per_text(symbols), dup, repeated[words.first[1:]] - repeated[words.first[:-1]], features, w1 - w0, line_first)


def _expected(score: np.ndarray, move: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded rows: the share of content of each line, and of each pair of states from a line to the next."""
    rows, steps, _ = score.shape
    score = np.where(real[..., None], score, 0)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0]
    for k in range(1, steps):
        nxt = np.logaddexp(alpha[:, k - 1, :1] + move[0], alpha[:, k - 1, 1:] + move[1]) + score[:, k]
        alpha[:, k] = np.where(real[:, k, None], nxt, alpha[:, k - 1])
    for k in range(steps - 2, -1, -1):
        after = score[:, k + 1] + beta[:, k + 1]
        nxt = np.logaddexp(move[:, 0][None] + after[:, :1], move[:, 1][None] + after[:, 1:])
        beta[:, k] = np.where(real[:, k + 1, None], nxt, 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    content = np.where(real, np.exp(alpha[..., 1] + beta[..., 1] - z[:, None]), 0)
    pairs = np.exp(alpha[:, :-1, :, None] + move[None, None] + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
    return content, pairs


def fit(lines: list[tuple[np.ndarray, int]], rounds: int = 3, steps: int = 60, rate: float = 0.1, penalty: float = 1e-3, length: int = 32) -> LineModel:
    """The field from documents whose quality is known, but not that of their lines.

    `lines`: (features of the lines of a document, its label). Expectation maximisation with the label as a weak constraint: the first round
    takes every line to be as its document and fits single lines only; each further round finds by
    forward-backward how far each line and each pair of neighbours is content under the field so far, with WEAK added to the log odds of lines of good documents and taken from
    those of bad ones, and fits the field to that. Long documents give several sequences of `length` lines.
    """
    lines = [(x, y) for x, y in lines if len(x)]
    if len({y for _, y in lines}) < 2:
        return LineModel(DEFAULT_EMIT, DEFAULT_MOVE)
    pieces = [(x[a : a + length], y) for x, y in lines for a in range(0, len(x), length)]
    pieces.sort(key=lambda p: -len(p[0]))
    rows, most = len(pieces), len(pieces[0][0])
    x, real, y = np.zeros((rows, most, len(FEATURES)), np.float32), np.zeros((rows, most), bool), np.array([p[1] for p in pieces])
    for i, (part, _) in enumerate(pieces):
        x[i, : len(part)], real[i, : len(part)] = part, True
    # both labels weigh the same in all
    weight = np.where(y == 1, 0.5 / max(1, real[y == 1].sum()), 0.5 / max(1, real[y == 0].sum()))
    scale = np.maximum(x[real].std(0), 1e-6)
    scale[0] = 1
    x /= scale
    flat, owner = x[real].astype(float), np.nonzero(real)[0]
    theta = np.zeros(len(FEATURES) + 4)
    hint = np.where(y == 1, WEAK, -WEAK)[:, None]
    for turn in range(rounds):
        scores = lambda: np.stack([np.zeros((rows, most)), x @ theta[:-4].astype(np.float32)], 2)
        if turn:
            hinted = scores()
            hinted[..., 1] += hint
            want, pairs = _expected(hinted, theta[-4:].reshape(2, 2), real)
            want_pairs = np.einsum("r,rsij->ij", weight, pairs)
        else:
            want = np.broadcast_to(y[:, None], real.shape) * real
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            grad = np.zeros_like(theta)
            if turn:
                share, found = _expected(scores(), theta[-4:].reshape(2, 2), real)
                grad[-4:] = (want_pairs - np.einsum("r,rsij->ij", weight, found)).ravel()
            else:
                share = real / (1 + np.exp(-np.clip(x @ theta[:-4].astype(np.float32), -30, 30)))
            grad[:-4] = ((want - share)[real] * weight[owner]) @ flat
            grad -= penalty * theta
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            theta = theta + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return LineModel(theta[:-4] / scale, theta[-4:].reshape(2, 2))


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS, allowed: Column | None = None) -> LineModel:
    """Fitted on at most `max_docs` documents of each label; their lines are measured in tasks and only features are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text):
            m = measure(buf, offs)
            ends = pa.array((m.first_line * len(FEATURES)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(m.features.ravel().astype(np.float32)))], ["_n", "_label", "_lines"])

    sample = labelled_sample(docs, labels, "quality", key, text, max_docs, allowed).mapInArrow(run, "_n int, _label int, _lines array<float>").toArrow().sort_by([("_label", "ascending"), ("_n", "ascending")])
    return fit([(np.asarray(v.values).reshape(-1, len(FEATURES)), y) for v, y in zip(sample["_lines"], sample["_label"].to_pylist(), strict=True)])


def judge(docs: DataFrame, model: LineModel, key: str = "doc_id", text: str = "text", min_share: float = MIN_CONTENT_SHARE, with_text: bool = False) -> DataFrame:
    """All columns of `docs`, but `text` only if wanted, the counts, base_failed, content_share (of words) and kept.

    A column of `docs` with the name of a result gives way to it."""
    names = COUNTS
    others = [c for c in docs.columns if (with_text or c != text) and c not in RESULTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text):
            m = measure(buf, offs)
            content = _running(m.line_words * (model.labels(m.features, m.first_line) == 1))
            share = (content[m.first_line[1:]] - content[m.first_line[:-1]]) / np.maximum(m.n_words, 1)
            failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
            counts = [pa.array(getattr(m, n), pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), *counts, pa.array(failed), pa.array(share), pa.array(~failed & (share >= min_share))], [*others, *names, "base_failed", "content_share", "kept"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{kinds}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, content_share double, kept boolean")
