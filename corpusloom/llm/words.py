"""Vectorised word scanning over Arrow string columns.

A column is cut into chunks of at most ``CHUNK_BYTES`` of UTF-8 (a longer text
is a chunk of its own), so memory follows the chunk and the longest text, never
the batch.  In a chunk, words are byte ranges; each has a 64-bit hash, and runs
of consecutive words are hashed from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_GAMMA = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * _GAMMA)


def _separators(spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Bytes that end a word: ASCII white space, or all ASCII but 0-9 and letters.
SPACE = _separators([(0x20, 0x20), (0x09, 0x0D)])
NOT_ALNUM = _separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


@lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    values = _stream(1, 256)
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << int(n).bit_length(), 1 << 12) if n <= CHUNK_BYTES else max(n, CHUNK_BYTES + 1)
        base = (int(_stream(seed, 1)[0]) | 1) & ~2 | 4 | 1
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=U64))
        if size > 8 * CHUNK_BYTES:
            return both[0], both[1]
        have = _POWERS[seed] = (both[0], both[1])
    return have


def runs(values: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``run_hash`` needs of a sequence of 64-bit values."""
    up, down = _powers(seed, len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def run_hash(prepared: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal wherever the same run stands."""
    sums, down = prepared
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * _GAMMA)


class Chunk:
    """Some rows of a column, and their words.

    rows: index of the first row and how many; data: their bytes; start, end:
    byte ranges of words; first: for each row the index of its first word, and
    at last the number of words; hash: of each word.
    """

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        self.row, self.data, self.offsets = row, data, offsets
        self.rows = len(offsets) - 1
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = run_hash(runs(_byte_values(lower)[data], 2), self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def grams(self, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and where they end in the row.

        Hashes where the row ends too early are not valid."""
        n = len(self.hash)
        out, valid = np.zeros(n, U64), np.zeros(n, bool)
        if n >= k:
            at = np.arange(n - k + 1)
            out[: n - k + 1] = run_hash(runs(self.hash, seed), at, at + k)
            limit = np.repeat(self.first[1:], self.counts)
            valid[: n - k + 1] = at + k <= limit[: n - k + 1]
        return out, valid

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def text_bytes(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column, separators: np.ndarray, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A column's rows, all of them, in order."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        to = min(to, n)
        yield Chunk(row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], separators, lower)
        row = to


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i:i+width]) for each i, as far as there are so many."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span : width - span + len(values) - width + 1])


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the place of the least of ``width`` grams from there on, the leftmost of equals.

    Returns places and whether all of the grams are valid (of one row).  The
    choice depends on the grams' values and order alone, so a run of words gets
    the same choice wherever it stands."""
    n = len(grams)
    bits = max(1, int(n).bit_length())
    low = U64((1 << bits) - 1)
    keyed = (grams & ~low) | np.arange(n, dtype=U64)
    least = sliding_min(keyed, width)
    place = (least & low).astype(np.int64)
    wrong = np.concatenate([[0], np.cumsum(~valid)])
    return place, wrong[width : width + len(place)] == wrong[: len(place)]
