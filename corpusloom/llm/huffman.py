"""Canonical length-limited Huffman codes over non-negative ids, with NumPy.

Codes come from counts by package-merge.  A stream of ids is packed most
significant bit first; every ``STEP`` ids the bit offset is kept, so the parts
between these checkpoints are decoded side by side from one table of
``2**limit`` entries.
"""

from __future__ import annotations

import numpy as np

LIMIT, STEP = 16, 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id's code, 0 where the count is 0; at most ``limit``, or as many as the ids need.

    Equal counts are ordered by id, so equal counts give equal codes."""
    counts = np.asarray(counts, np.float64)
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order]
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        single = np.concatenate([np.ones(len(weights), bool), np.zeros(len(packages), bool)])
        by = np.lexsort((~single, both))
        both, single = both[by], single[by]
        levels.append(single)
        even = len(both) // 2 * 2
        packages = both[0:even:2] + both[1:even:2]
    take, bits = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for single in reversed(levels):
        items = int(single[:take].sum())
        bits[:items] += 1
        take = 2 * (take - items)
    out[order] = bits
    return out


class Code:
    """The canonical code of some lengths: shorter codes first, then lower ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        bits = self.lengths[order].astype(np.int64)
        self.width = int(bits.max()) if len(bits) else 1
        spans = np.left_shift(np.int64(1), self.width - bits)
        first = np.cumsum(spans) - spans
        self.aligned = np.zeros(len(self.lengths), np.uint64)
        self.aligned[order] = first.astype(np.uint64) << np.uint64(64 - self.width)
        self.table = np.zeros(1 << self.width, np.int64)
        filled = int(spans.sum())
        self.table[:filled] = np.repeat(order.astype(np.int64) << 6 | bits, spans)

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
        """The packed bits, and the bit offset of every ``step`` ids."""
        bits = self.lengths[ids].astype(np.int64)
        if len(bits) and not bits.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(bits)
        offsets = (ends - bits)[::step]
        total = int(ends[-1]) if len(ends) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        for at in range(0, len(ids), 1 << 16):
            part = slice(at, at + (1 << 16))
            start, code = ends[part] - bits[part], self.aligned[ids[part]]
            word, off = start >> 6, (start & 63).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] |= np.bitwise_or.reduceat(code >> off, first)  # no code has more than 64 bits, so each word has a start
            over = np.flatnonzero((start & 63) + bits[part] > 64)
            words[word[over] + 1] |= code[over] << (np.uint64(64) - off[over])
        return words.astype(">u8").tobytes()[: (total + 7) // 8], offsets

    def decode(self, payloads: list[bytes], offsets: list[np.ndarray], counts: np.ndarray, step: int = STEP) -> np.ndarray:
        """Ids of several blocks, one after the other."""
        if not len(counts):
            return np.zeros(0, np.int64)
        sizes = np.array([len(x) + 8 for x in payloads], np.int64)
        data = np.frombuffer(b"".join(x + bytes(8) for x in payloads), np.uint8)
        base = (np.cumsum(sizes) - sizes) * 8
        lanes = np.array([len(x) for x in offsets])
        bit = np.concatenate(offsets).astype(np.int64) + np.repeat(base, lanes)
        left = np.full(len(bit), step, np.int64)
        ends = np.cumsum(lanes) - 1
        some = lanes > 0
        left[ends[some]] = counts[some] - (lanes[some] - 1) * step
        out_at = np.cumsum(left) - left
        out = np.empty(int(left.sum()), np.int64)
        wide = np.zeros(len(data), np.uint32)
        n = len(data) - 3
        wide[:n] = data[:n].astype(np.uint32) << 24 | data[1 : n + 1].astype(np.uint32) << 16 | data[2 : n + 2].astype(np.uint32) << 8 | data[3 : n + 3]
        mask, shift = (1 << self.width) - 1, 32 - self.width
        order = np.argsort(-left, kind="stable")
        bit, out_at, left = bit[order], out_at[order], left[order]
        for k in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -k, "left"))
            b = bit[:live]
            entry = self.table[(wide[b >> 3] >> (shift - (b & 7)).astype(np.uint32)) & mask]
            out[out_at[:live] + k] = entry >> 6
            bit[:live] = b + (entry & 63)
        return out
