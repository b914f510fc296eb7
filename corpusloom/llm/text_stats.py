"""Statistics of whole texts, a chunk of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tables as T
from . import words as W

NAMES = (
    "chars", "words", "mean_word", "longest_word", "upper", "digits", "marks", "odd_marks", "high_bytes", "ends",
    "distinct", "top_word", "repeats", "distinct_pairs", "distinct_triples", "lines", "mean_line", "distinct_lines", "short_words", "upper_words", "no_vowel",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_UPPER = _class(bytes(range(65, 91)))
_DIGIT = _class(bytes(range(48, 58)))
_MARK = _class(bytes(x for x in range(33, 127) if not chr(x).isalnum()))
_ODD = _class(b"#$%&*+/<=>@[\\]^_`{|}~!")
_END = _class(b".!?")
_HIGH = _class(bytes(range(128, 256)))
_CONT = _class(bytes(range(128, 192)))
_VOWEL = _class(b"aeiouyAEIOUY") + _HIGH


def _per(flags: np.ndarray, edges_from: np.ndarray, edges_to: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[edges_to] - total[edges_from]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, by row."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], counts)
    return np.bincount(r[at], minlength=n).astype(float), top


def of_chunk(c: W.Chunk) -> dict[str, np.ndarray]:
    data, a, b = c.data, c.offsets[:-1], c.offsets[1:]
    rows, n = c.row_of_word(), c.counts
    size = b - a - _per(_CONT[data], a, b)
    lengths = c.end - c.start - _per(_CONT[data], c.start, c.end)
    f, l = c.first[:-1], c.first[1:]
    longest = np.zeros(c.rows)
    np.maximum.at(longest, rows, lengths)
    single, top = _distinct(c.hash, rows, c.rows)
    again = np.zeros(len(rows), np.int64)
    again[1:] = (c.hash[1:] == c.hash[:-1]) & (rows[1:] == rows[:-1])
    out = {"chars": size, "words": n, "mean_word": _share(_per(lengths, f, l), n), "longest_word": longest}
    for name, table in (("upper", _UPPER), ("digits", _DIGIT), ("marks", _MARK), ("odd_marks", _ODD), ("high_bytes", _HIGH)):
        out[name] = _share(_per(table[data], a, b), size)
    out["ends"] = _share(_per(_END[data], a, b), n)
    out |= {"distinct": _share(single, n), "top_word": _share(top, n), "repeats": _share(_per(again, f, l), n)}
    for k, name in ((2, "distinct_pairs"), (3, "distinct_triples")):
        grams, valid = c.grams(k)
        kinds, _ = _distinct(grams[valid], rows[valid], c.rows)
        out[name] = _share(kinds, np.maximum(n - k + 1, 0))
    is_break = data == 10
    breaks = np.flatnonzero(is_break)
    line_from = np.sort(np.concatenate([a, breaks + 1]))
    line_row = np.searchsorted(b, line_from, "right")
    keep = line_row < c.rows
    keep[keep] &= line_from[keep] >= a[line_row[keep]]
    line_from, line_row = line_from[keep], line_row[keep]
    line_to = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_from)], b[line_row])
    some = line_to > line_from
    line_from, line_to, line_row = line_from[some], line_to[some], line_row[some]
    n_lines = np.bincount(line_row, minlength=c.rows)
    hashes = W.run_hash(W.runs(W._byte_values(False)[data], 2), line_from, line_to) if len(data) else np.zeros(0, np.uint64)
    kinds, _ = _distinct(hashes, line_row, c.rows)
    out |= {"lines": n_lines, "mean_line": _share(size, n_lines), "distinct_lines": _share(kinds, n_lines)}
    out["short_words"] = _share(_per((lengths <= 3).astype(np.int64), f, l), n)
    out["upper_words"] = _share(_per((_per(_UPPER[data], c.start, c.end) * 2 > lengths).astype(np.int64), f, l), n)
    out["no_vowel"] = _share(_per((_per(_VOWEL[data], c.start, c.end) == 0).astype(np.int64), f, l), n)
    return out


def text_stats(documents: DataFrame, keep: str = "doc_id long") -> DataFrame:
    """The kept columns and all statistics; a null text is empty."""
    kept = [x.split()[0] for x in keep.split(", ")]

    def run(batch: pa.RecordBatch):
        for c in W.chunks(batch.column("text"), W.SPACE):
            found = of_chunk(c)
            yield {k: batch.column(k).slice(c.row, c.rows) for k in kept} | {k: np.asarray(found[k], float) for k in NAMES}

    return T.map_batches(documents.select(*[k for k in kept if k != "text"], "text"), run, keep + ", " + ", ".join(f"{k} double" for k in NAMES))
