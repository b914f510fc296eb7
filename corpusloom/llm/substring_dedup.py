"""Substring dedup by seed and extend.

Winnowed anchors (the least of the k-gram hashes in each window of words) are
the seeds: equal windows choose the same anchor, so documents that share a
window share its anchor.  An occurrence of an anchor is extended both ways to
the whole run of windows that chose it.  Occurrences with an equal run form a
class, of which the smallest doc_id counts; every other document of the class
has the run in an earlier document.  Where one anchor has several classes, the
first document of each class is opened and its single windows are compared, so
no pair of documents is ever formed and a passage in a third of all documents
is one class, whose documents meet its head by broadcast.

Anchors are found once and written; rows are told apart by doc_id and a hash of
the text, so many rows of one doc_id, or without one, spread like any others.

Cases: a null text has no words; a text of fewer words than the window keeps
all; equal doc_ids never remove from one another; a null doc_id counts as
larger than every other; repeated rows each give a row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables as T
from . import words as W

WINDOW, GRAM = 50, 8
_RUN, _WINDOW = 5, 7


class _Runs:
    """The anchors of a chunk: row, anchor, run, first and last window of each."""

    def __init__(self, chunk: W.Chunk, window: int, gram: int):
        grams, valid = chunk.grams(gram)
        place, whole = W.winnow(grams, valid, window - gram + 1)
        starts = np.flatnonzero(whole)
        anchor, row = place[starts], chunk.row_of_word()[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(starts))[: len(at)] - 1
        self.row, self.first, self.last = row[at], starts[at], starts[last]
        anchor = anchor[at]
        self.anchor = grams[anchor]
        words = W.runs(chunk.hash, _RUN)
        self.run = W.run_hash(words, self.first, self.last + window) ^ W.mix((anchor - self.first).astype(np.uint64))


def _salted(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return W.mix(keys.view(np.uint64) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _window_hashes(chunk: W.Chunk, starts: np.ndarray, window: int) -> np.ndarray:
    return W.run_hash(W.runs(chunk.hash, _WINDOW), starts, starts + window)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of runs, and the index of their run."""
    n = last - first + 1
    run = np.repeat(np.arange(len(first)), n)
    return np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + first[run], run


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    items, rows = T.list_items(column)
    return items.astype(np.int64, copy=False), rows


_ROW = ["_key", "_tag"]


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The runs to remove: _key, _tag, runs (keys of whole runs), windows (hashes of single windows).

    docs: _key and _tag (long), which tell rows apart, and text."""

    def anchors_of(batch: pa.RecordBatch):
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in _ROW)
        for chunk in W.chunks(batch.column("text"), W.SPACE):
            x = _Runs(chunk, window, gram)
            once = np.unique(_salted(x.run ^ x.anchor, x.row), return_index=True)[1]  # a run that repeats in a document counts once
            row = chunk.row + x.row[once]
            yield {"anchor": x.anchor[once], "run": x.run[once], "_key": ids[row], "_tag": tags[row]}

    anchors = T.written(T.map_batches(docs, anchors_of, "anchor long, run long, _key long, _tag long"))
    classes = T.written(anchors.groupBy("anchor", "run").agg(F.min("_key").alias("head"), F.max("_key").alias("tail"), F.count("*").alias("rows")))
    again = classes.filter("head < tail")
    whole = T.hot_joined(anchors, again.select("anchor", "run", "head", "rows"), ["anchor", "run"], "rows").filter("_key > head")
    whole = T.written(whole.select(*_ROW, F.col("run").alias("key"), F.lit(True).alias("whole")))
    several = classes.groupBy("anchor").agg(F.count("*").alias("n"), F.min("head").alias("a"), F.max("tail").alias("b")).filter("n > 1 and a < b")
    heads = T.written(T.hot_joined(classes, several.select("anchor", "n"), ["anchor"], "n").select("anchor", "run", "head", "rows"))
    mine = T.hot_joined(anchors, heads, ["anchor", "run"], "rows").filter("_key = head")  # all rows of the least doc_id
    opened = T.written(mine.groupBy(*_ROW).agg(F.collect_list("run").alias("runs")))

    def windows_of(batch: pa.RecordBatch):
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in _ROW)
        wanted, rows = _listed(batch.column("runs"))
        for chunk in W.chunks(batch.column("text"), W.SPACE):
            x = _Runs(chunk, window, gram)
            mine = (rows >= chunk.row) & (rows < chunk.row + chunk.rows)
            take = np.isin(_salted(x.run, x.row + chunk.row), _salted(wanted[mine], rows[mine]))
            starts, run = _spread(x.first[take], x.last[take])
            anchor, found, row = x.anchor[take][run], _window_hashes(chunk, starts, window), x.row[take][run]
            once = np.unique(_salted(found ^ anchor, row), return_index=True)[1]
            row = chunk.row + row[once]
            yield {"anchor": anchor[once], "window": found[once], "_key": ids[row], "_tag": tags[row]}

    # one row of those that are equal: they have the same runs
    texts = docs.join(opened.hint("merge"), _ROW).dropDuplicates(_ROW)
    windows = T.written(T.map_batches(texts, windows_of, "anchor long, window long, _key long, _tag long"))
    firsts = windows.groupBy("anchor", "window").agg(F.min("_key").alias("head"), F.max("_key").alias("tail"), F.count("*").alias("rows")).filter("head < tail")
    single = T.hot_joined(windows, firsts.select("anchor", "window", "head", "rows"), ["anchor", "window"], "rows").filter("_key > head").select(*_ROW, F.col("window").alias("key"), F.lit(False).alias("whole"))
    return (
        whole.unionByName(single)
        .groupBy(*_ROW)
        .agg(F.collect_set(F.when(F.col("whole"), F.col("key"))).alias("runs"), F.collect_set(F.when(~F.col("whole"), F.col("key"))).alias("windows"))
    )


@T.tidy
def removed_words(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (its words, joined by one space), spans (removed words as [first, after] pairs).

    A word goes where a window of ``window`` words covers it that also starts in a document with a smaller id."""
    docs = documents.select(T.doc_key(id_col).alias("_key"), F.xxhash64(text_col).alias("_tag"), F.col(text_col).alias("text"))
    found = T.written(repeats(docs, window, gram))

    def cut(batch: pa.RecordBatch):
        ids = batch.column("_key").to_numpy(zero_copy_only=False)
        run_keys, run_rows = _listed(batch.column("runs"))
        win_keys, win_rows = _listed(batch.column("windows"))
        for chunk in W.chunks(batch.column("text"), W.SPACE):
            n = chunk.counts
            step = np.zeros(len(chunk.hash) + 1, np.int64)
            mine = (run_rows >= chunk.row) & (run_rows < chunk.row + chunk.rows)
            if mine.any():
                x = _Runs(chunk, window, gram)
                take = np.isin(_salted(x.run, x.row + chunk.row), _salted(run_keys[mine], run_rows[mine]))
                np.add.at(step, x.first[take], 1)
                np.add.at(step, x.last[take] + window, -1)
            mine = (win_rows >= chunk.row) & (win_rows < chunk.row + chunk.rows)
            if mine.any():
                touched = np.zeros(chunk.rows, bool)
                touched[win_rows[mine] - chunk.row] = True
                row = chunk.row_of_word()
                last = chunk.first[1:][row] - window
                starts = np.flatnonzero(touched[row] & (np.arange(len(row)) <= last))
                hashes = _window_hashes(chunk, starts, window)
                starts = starts[np.isin(_salted(hashes, row[starts] + chunk.row), _salted(win_keys[mine], win_rows[mine]))]
                np.add.at(step, starts, 1)
                np.add.at(step, starts + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            lost = total[chunk.first[1:]] - total[chunk.first[:-1]]
            kept, spans = [], []
            for i in range(chunk.rows):
                words = chunk.text_bytes(i).split()
                if lost[i]:
                    mask = gone[chunk.first[i] : chunk.first[i + 1]]
                    words = compress(words, ~mask)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    spans.append(edges.reshape(-1, 2).tolist())
                else:
                    spans.append([])
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            mine = ids[chunk.row : chunk.row + chunk.rows]
            yield {"doc_id": pa.array(mine, mask=mine == T.LAST_ID), "n_words": n, "n_removed": lost, "kept": kept, "spans": spans}

    joined = docs.join(found.hint("merge"), _ROW, "left").select("_key", "text", "runs", "windows")
    return T.map_batches(joined, cut, "doc_id long, n_words long, n_removed long, kept string, spans array<array<int>>")


def kept_digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return kept_digest(removed_words(T.read(spark, sf_dir, "documents")))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS head FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (h) WHERE win.doc_id > firsts.head),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
