"""Sampled SentencePiece segmentation, by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for every vocabulary piece that matches and a byte-fallback edge for every
character. Where two neighbouring characters of a text are neighbours in no piece, no piece spans them, so the lattice falls into
units that are filtered on their own, without loss: a unit's forward sums are computed once for each distinct unit of a chunk, and every
occurrence samples its path backwards. The random number of a step is a hash of seed, row key and character position, so
a row's segmentation does not depend on partitions, batches or neighbours.

Merge models store ranks, not probabilities: piece weights are taken as 1 / (rank + SHIFT) ** alpha. Spaces become the
meta symbol, and the meta symbol itself is written in bytes, so decoding gives back every text.

Defined results: null and empty texts have no pieces and decode to the empty string; repeated rows with one key are segmented alike;
a null key counts as the empty string; a draw that equals a bound of shares takes the longer piece; an empty table gives no rows; other columns are kept by
`encode` and `decode`. Texts are read whole: a unit of any length is filtered in windows, with twelve bytes a character between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.textwords import chunks, mixed, powers, string_bytes, words_of

#: Fixed values of the default model: its file, and its first byte piece.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = 0x2581
SHIFT, FALLBACK = 2.7, 1e-6
WIDE = 48  # longer units are filtered in windows; beyond this, products could leave the range of doubles
WINDOW, RESCALE = 4096, 2.0**332  # a power of two, so scaled sums are the same doubles
JOINED_BITS = 22
CELLS = 1 << 20  # of a block's tables: units by positions by lengths of edges
CHUNK_BYTES = 1 << 20
_OTHER = 0x110000  # stands for a literal meta symbol; in no piece
_B = np.uint64(0x9E3779B97F4A7C15)
BYTES = -2  # marks a byte-fallback edge until it is spelled out


def neighbours(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A place in the bitmap of neighbouring characters."""
    return ((a * 0x9E3779B1 ^ b * 0x85EBCA6B) >> 7) & ((1 << JOINED_BITS) - 1)


@dataclass
class Vocabulary:
    """Weights of pieces, found through hashes of all prefixes of pieces."""

    pieces: dict[str, tuple[int, float]]
    first_byte: int
    size: int

    def __post_init__(self) -> None:
        prefixes: dict[int, tuple[int, float]] = {}
        for piece, (i, w) in self.pieces.items():
            h = 0
            for n, c in enumerate(piece, 1):
                h = (h * int(_B) + ord(c) + 1) & (2**64 - 1)
                if n == len(piece):
                    prefixes[h] = (i, w)
                else:
                    prefixes.setdefault(h, (-1, 0.0))
        self.keys = np.array(sorted(prefixes), np.uint64)
        self.ids = np.array([prefixes[int(k)][0] for k in self.keys], np.int32)
        self.weights = np.array([prefixes[int(k)][1] for k in self.keys])
        # two tables of places, by different bits of the hash; a key is in one of them
        self.bits = 20
        self.tables = np.full((2, 1 << self.bits), 0, np.int32)
        spots = self._spots(self.keys)
        held: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for at in range(len(self.keys)):
            side = 0
            for _ in range(500):  # whoever sits in the place moves to its other one
                spot = int(spots[side, at])
                at, held[side][spot] = held[side].get(spot, -1), at
                if at < 0:
                    break
                side = 1 - side
            else:
                raise ValueError("the tables are too small for this vocabulary")
        for side in (0, 1):
            self.tables[side, list(held[side])] = list(held[side].values())
        self.longest = max(map(len, self.pieces), default=1)
        # neighbouring characters of pieces, as a bitmap over their hash: where two neighbours of a text are not in it, no piece spans them
        self.joined = np.zeros(1 << JOINED_BITS, bool)
        pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.joined[neighbours(np.array([ord(p[0]) for p in pairs], np.int64), np.array([ord(p[1]) for p in pairs], np.int64))] = True
        self.texts = {i: piece.replace("▁", " ").encode() for piece, (i, _) in self.pieces.items()}
        self.texts |= {self.first_byte + b: bytes([b]) for b in range(256)}
        parts = [self.texts.get(i, b"") for i in range(self.size)]
        self.spelled = np.frombuffer(b"".join(parts), np.uint8)
        self.length = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def _spots(self, h: np.ndarray) -> np.ndarray:
        m = mixed(h)
        return np.stack([m >> np.uint64(64 - self.bits), m & np.uint64((1 << self.bits) - 1)]).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in `keys`, or -1."""
        a, b = self._spots(h)
        one, two = self.tables[0, a], self.tables[1, b]
        return np.where(self.keys[one] == h, one, np.where(self.keys[two] == h, two, -1))


def load(path: str = MODEL, alpha: float = 1.0) -> Vocabulary:
    """The vocabulary of a SentencePiece model with byte fallback, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    first = model.piece_to_id("<0x00>")
    usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    weight = lambda i: (min(-model.get_score(i), float(n)) + SHIFT) ** -alpha
    return Vocabulary({model.id_to_piece(i): (i, weight(i)) for i in usual}, first, n)


def uniform(seed: int, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) with 24 bits, from seed, row key hash and position."""
    h = mixed(mixed(keys + np.uint64(seed)) + at.astype(np.uint64) * _B)
    return ((h >> np.uint64(40)).astype(np.float32)) * np.float32(2**-24)


def key_hashes(keys: pa.Array) -> np.ndarray:
    text = keys.cast(pa.string()).fill_null("")
    buf, offs = string_bytes(text)
    out = np.zeros(len(text), np.uint64)
    w = words_of(buf, offs, np.ones(256, bool), lower=False)
    out[np.diff(offs) > 0] = w.hash
    return out


def _lattice(codes: np.ndarray, lens: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For units (rows of `codes`): weight[u, j, l - 1] and edges[u, j, l - 1] of the piece of l characters that ends before position j, 0 and -1 if there is none."""
    n, width = codes.shape
    most = min(v.longest, width)
    weight = np.zeros((n, width + 1, most))
    edges = np.full((n, width + 1, most), -1, np.int32)
    unit, at = np.nonzero(np.arange(width)[None] < lens[:, None])
    weight[unit, at + 1, 0], edges[unit, at + 1, 0] = FALLBACK, BYTES
    h = np.zeros(len(unit), np.uint64)
    for size in range(1, most + 1):
        ok = at + size <= lens[unit]
        unit, at, h = unit[ok], at[ok], h[ok]
        h = h * _B + codes[unit, at + size - 1].astype(np.uint64) + np.uint64(1)
        place = v.find(h)
        ok = place >= 0
        unit, at, h, place = unit[ok], at[ok], h[ok], place[ok]
        if not len(unit):
            break
        whole = v.ids[place] >= 0
        u, j, p = unit[whole], at[whole] + size, place[whole]
        weight[u, j, size - 1], edges[u, j, size - 1] = v.weights[p], v.ids[p]
    return weight, edges


def _filtered(codes: np.ndarray, lens: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For units (rows of `codes`): shares[u, j, l - 1], the running share of paths into j whose last edge has up to l characters,
    and edges[u, j, l - 1], the piece of that edge."""
    weight, edges = _lattice(codes, lens, v)
    n, width, most = len(codes), codes.shape[1], weight.shape[2]
    into = np.zeros((n, width + 1))
    into[:, 0] = 1
    for j in range(1, width + 1):
        k = min(j, most)
        weight[:, j, :k] *= into[:, j - k : j][:, ::-1]
        into[:, j] = np.cumsum(weight[:, j, :k], axis=1)[:, -1]  # added in order, as in windows
    shares = np.cumsum(weight, axis=2)
    shares /= np.maximum(into[..., None], 1e-300)
    last = most - 1 - np.argmax(weight[..., ::-1] > 0, axis=2)
    np.put_along_axis(shares, last[..., None], 2.0, axis=2)  # the last possible edge takes what rounding leaves
    return shares, edges


def _in_windows(codes: np.ndarray, v: Vocabulary, draws) -> Iterator[tuple[int, int]]:
    """(start, piece) of one long unit, last piece first. The lattice is made for a window of positions at a time, forward to filter and again backward to
    sample; between, a position keeps one number and its scale. `draws(a, b)`: the numbers drawn at positions a to b - 1."""
    n, most = len(codes), min(v.longest, len(codes))
    into, scale = np.empty(n + 1), np.zeros(n + 1, np.int32)
    into[0], now, recent = 1.0, 0, [1.0]  # what leads into the last positions, nearest first, at the present scale

    def window(start: int, end: int) -> tuple[int, np.ndarray, np.ndarray]:
        a = max(0, start - most + 1)
        weight, edges = _lattice(codes[None, a:end], np.array([end - a]), v)
        return a, weight[0], edges[0]

    for start in range(0, n, WINDOW):
        end = min(n, start + WINDOW)
        a, weight, _ = window(start, end)
        for j, row in enumerate(weight[start + 1 - a :].tolist(), start + 1):
            total = sum(map(mul, row, recent))
            if not 1 / RESCALE < total < RESCALE:
                by = RESCALE if total < 1 else 1 / RESCALE
                total, recent, now = total * by, [x * by for x in recent], now + (1 if total < 1 else -1)
            into[j], scale[j] = total, now
            recent = [total, *recent[: most - 1]]
    j = n
    while j:
        start = max(0, j - WINDOW)
        a, weight, edges = window(start, j)
        drawn = draws(start + 1, j + 1)
        while j > start:
            row = weight[j - a]
            sizes = np.flatnonzero(row[: min(j, len(row))]) + 1
            share = np.cumsum(row[sizes - 1] * into[j - sizes] * RESCALE ** (scale[j] - scale[j - sizes]).astype(float)) / into[j]
            size = int(sizes[min(int(np.searchsorted(share, drawn[j - start - 1], "right")), len(sizes) - 1)])
            piece = int(edges[j - a, size - 1])
            j -= size
            yield j, piece


def segment(buf: np.ndarray, offs: np.ndarray, keys: np.ndarray, v: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts of a chunk, and of each text where its pieces begin."""
    head = (buf & 0xC0) != 0x80
    char_offs = np.concatenate(([0], np.cumsum(head)))[offs]
    codes = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    chosen = np.full(len(codes), -1, np.int32)
    if len(codes):
        seen = codes.copy()
        seen[codes == META] = _OTHER
        seen[codes == 32] = META
        begins = np.zeros(len(codes), bool)
        begins[1:] = ~v.joined[neighbours(seen[:-1], seen[1:])]
        begins[char_offs[:-1][np.diff(char_offs) > 0]] = True
        start = np.flatnonzero(begins)
        lens = np.diff(np.concatenate((start, [len(codes)])))
        text = np.searchsorted(char_offs, start, "right") - 1
        place = np.arange(len(codes)) - np.repeat(start, lens)
        named = mixed(np.add.reduceat((seen.astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[place], start) + lens.astype(np.uint64))
        base = char_offs[:-1][text]
        for i in np.flatnonzero(lens > WIDE).tolist():
            s, k = int(start[i]), keys[text[i]]
            draws = lambda a, b: uniform(seed, np.full(b - a, k), np.arange(s + a - base[i], s + b - base[i]))  # noqa: E731,B023
            for at, piece in _in_windows(seen[s : s + lens[i]], v, draws):
                chosen[s + at] = piece
        short = np.flatnonzero(lens <= WIDE)
        _, first, inverse = np.unique(named[short], return_index=True, return_inverse=True)
        order = np.argsort(lens[short[first]], kind="stable")  # units of like length share a block
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        inverse = rank[inverse]
        units = short[first[order]]
        by_unit = np.argsort(inverse, kind="stable")
        cuts = [0]
        while cuts[-1] < len(units):
            end = cuts[-1]
            for width in (int(lens[units[end]]), 0):  # units come by length: the last one's width counts
                end = min(len(units), cuts[-1] + max(1, CELLS // ((width or int(lens[units[end - 1]])) + 1) // v.longest))
            cuts.append(end)
        bounds = np.searchsorted(inverse[by_unit], cuts)
        for b, (a, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            block = units[a:end]
            n = lens[block]
            width = int(n.max())
            at = start[block][:, None] + np.arange(width)[None]
            shares, edges = _filtered(seen[np.minimum(at, len(seen) - 1)], n, v)
            rows = by_unit[bounds[b] : bounds[b + 1]]
            occ, u = short[rows], inverse[rows] - a
            pos = lens[occ].copy()
            while len(occ):
                r = uniform(seed, keys[text[occ]], start[occ] + pos - base[occ])
                size = (shares[u, pos] <= r[:, None]).sum(1) + 1
                piece = edges[u, pos, size - 1]
                pos -= size
                chosen[start[occ] + pos] = piece
                more = pos > 0
                occ, u, pos = occ[more], u[more], pos[more]
    at = np.flatnonzero(chosen != -1)
    piece = chosen[at]
    spelled = piece == BYTES
    # byte-fallback edges become the bytes of their character
    byte_at = np.concatenate((np.flatnonzero(head), [len(buf)]))
    n_bytes = np.where(spelled, byte_at[at + 1] - byte_at[at], 1) if len(at) else np.zeros(0, np.int64)
    ids = np.repeat(piece, n_bytes)
    ends = np.cumsum(n_bytes)
    if spelled.any():
        inner = np.arange(len(ids)) - np.repeat(ends - n_bytes, n_bytes)
        source = np.repeat(byte_at[at], n_bytes) + inner
        wide = np.repeat(spelled, n_bytes)
        ids[wide] = v.first_byte + buf[source[wide]]
    return ids, np.concatenate(([0], ends))[np.searchsorted(at, char_offs)]


def spell(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The bytes that piece ids stand for."""
    n = v.length[ids]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return v.spelled[np.repeat(v.begin[ids], n) + inner]


def _field(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def encode(docs: DataFrame, v: Vocabulary, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """All columns of `docs` and piece_ids array<int>, which takes the place of a column of that name."""
    docs = docs.drop("piece_ids")
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in chunks(batches, text, CHUNK_BYTES):
            ids, first = segment(buf, offs, key_hashes(_field(part, key)), shared.value, seed)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], [*part.schema.names, "piece_ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, piece_ids array<int>")


def decode(df: DataFrame, v: Vocabulary, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """All columns and the text that the ids stand for (in the place of a column named `out`); a null list decodes to the empty string."""
    df = df.drop(out) if out != ids else df
    shared = df.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [spell(np.asarray(x.values), shared.value).tobytes().decode("utf-8", "replace") if x.is_valid and len(x.values) else "" for x in _field(part, ids)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{out}` string")


def digests(docs: DataFrame, v: Vocabulary, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """key, n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit integers) and lossless (decoded bytes equal the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        for part, buf, offs in chunks(batches, text, CHUNK_BYTES):
            ids, first = segment(buf, offs, key_hashes(_field(part, key)), voc, seed)
            back = spell(ids, voc)
            lengths = np.concatenate(([0], np.cumsum(voc.length[ids])))[first]
            whole = np.array_equal(back, buf) and np.array_equal(lengths, offs)
            same = [whole or np.array_equal(back[a:b], buf[c:d]) for a, b, c, d in zip(lengths[:-1], lengths[1:], offs[:-1], offs[1:], strict=True)]
            in_bytes = np.concatenate(([0], np.cumsum((ids >= voc.first_byte) & (ids < voc.first_byte + 256))))[first]
            raw = ids.astype("<i4")
            sha = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [_field(part, key), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(in_bytes), pa.int64()), pa.array(sha), pa.array(same, pa.bool_())],
                [key, "n_pieces", "n_byte_pieces", "ids_sha256", "lossless"],
            )

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_pieces long, n_byte_pieces long, ids_sha256 string, lossless boolean")
