"""Vectorised words of Arrow string batches: offsets, 64-bit word hashes and n-gram hashes.

Works on the UTF-8 bytes. All word rules of this subpackage end words at ASCII characters only,
so bytes of other characters (0x80 and above) never end a word. Texts are taken in chunks of a few megabytes; a single
longer text is a chunk of its own, so no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 2048
#: Fixed odd multipliers of the hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GRAM = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: all but space and \t\n\v\f\r.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes: digits, lower-case letters (after lower-casing A-Z) and all other characters above ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 to _BASE ** (n - 1), mod 2 ** 64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64, 2 * len(_powers)), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that high and low bits are equally good."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, nulls as empty, and their offsets (one more than strings)."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


@dataclass
class Words:
    """Words of the texts of one chunk. Word i of the chunk spans bytes start[i] to end[i]."""

    buf: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text its first word, and the number of words at last

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of n words from each word on; wrong for the last n - 1 words of a text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        g = self.hash[:m].copy()
        for j in range(1, n):
            g *= _GRAM
            g += self.hash[j : j + m]
        return mixed(g)


def words_of(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, lower: bool = True) -> Words:
    mask = is_word[buf]
    filled = offs[:-1][np.diff(offs) > 0]
    before = np.zeros(len(buf), bool)
    before[1:] = mask[:-1]
    before[filled] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = mask[1:]
    after[offs[1:][np.diff(offs) > 0] - 1] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    if len(start):
        at = np.flatnonzero(mask)
        lens = end - start
        place = at - np.repeat(start, lens)
        values = (LOWER[buf] if lower else buf)[at].astype(np.uint64) + np.uint64(1)
        values *= powers(int(lens.max()))[place]
        h = mixed(np.add.reduceat(values, np.concatenate(([0], np.cumsum(lens)[:-1]))) + lens.astype(np.uint64) * _GRAM)
    else:
        h = np.zeros(0, np.uint64)
    return Words(buf, offs, start, end, h, np.searchsorted(start, offs))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `size` bytes of text and at most CHUNK_ROWS rows: rows, bytes, offsets."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lens = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        ends = np.cumsum(lens)
        at = 0
        while at < len(lens):
            base = ends[at - 1] if at else 0
            to = max(at + 1, min(at + CHUNK_ROWS, int(np.searchsorted(ends, base + size, "right"))))
            part = batch.slice(at, to - at)
            yield part, *string_bytes(part.column(part.schema.get_field_index(text)))
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
