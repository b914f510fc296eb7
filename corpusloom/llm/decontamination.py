"""Benchmark decontamination by winnowing.

Every span of ``window`` words has ``window - gram + 1`` grams; the least of
their hashes is kept as a fingerprint, so a document and a benchmark item that
share a span share a fingerprint.  Fingerprints found in the benchmark are
extended to all windows around them, and each such window is looked up among
the benchmark's windows.  Items shorter than the window are one window of their
own length, of which every position is a fingerprint.

A benchmark of at most ``block_items`` items and ``block_chars`` characters, which
is counted first, is an index that travels with the tasks, and documents pass it
without a shuffle.  A larger one stays a table: its fingerprints are joined with
those of the documents' distinct texts, and of the texts that share some, the
windows that chose such a fingerprint are joined with the benchmark's windows.
Neither the driver nor a task ever holds such a benchmark.

Cases: null and empty texts and texts without words have no words and hit
nothing, and an item like that is never found; equal items are each counted;
items with a null item_id hit words and count, and are written as an empty
string; repeated documents each give a row; an empty table on either side gives
no hits or no rows; further columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables as T
from . import words as W

WINDOW, GRAM = 10, 5
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4_000_000
_SPAN = 9


class Index:
    """Fingerprints and windows of a block of items, by length of the window."""

    def __init__(self, ids: list, texts: list, window: int, gram: int):
        self.window, self.gram, self.ids = window, gram, ids
        prints, spans, items = {}, {}, {}
        for chunk in W.chunks(pa.array(texts, pa.string()), W.NOT_ALNUM, True):
            count, row = chunk.counts, chunk.row_of_word()
            place = np.arange(len(row))
            prepared = W.runs(chunk.hash, _SPAN)
            for m in np.unique(np.minimum(count[count > 0], window)):
                m = int(m)
                mine = (count[row] == m) if m < window else (count[row] >= window)
                starts = place[mine & (place + m <= chunk.first[1:][row])]
                spans.setdefault(m, []).append(W.run_hash(prepared, starts, starts + m))
                items.setdefault(m, []).append(row[starts] + chunk.row)
                if m == window:
                    grams, valid = chunk.grams(gram)
                    least, _ = W.winnow(grams, valid, window - gram + 1)
                    prints.setdefault(m, []).append(grams[np.unique(least[starts])])
        self.prints = {m: np.unique(np.concatenate(x)) for m, x in prints.items()}
        self.spans = {}
        for m in spans:
            h, i = np.concatenate(spans[m]), np.concatenate(items[m])
            order = np.lexsort((i, h))
            h, i = h[order], i[order]
            keys, at = np.unique(h, return_index=True)
            self.spans[m] = (keys, np.append(at, len(h)), i)


def _among(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values, at


def _hits(chunk: W.Chunk, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words of a chunk; the row and the item of every window found."""
    row = chunk.row_of_word()
    step = np.zeros(len(row) + 1, np.int64)
    prepared = W.runs(chunk.hash, _SPAN) if len(row) else None
    rows, items = [], []
    for m, (keys, at, item) in index.spans.items():
        if not len(row):
            break
        limit = chunk.first[1:][row] - m
        if m == index.window:
            grams, valid = chunk.grams(index.gram)
            width = m - index.gram + 1
            least, whole = W.winnow(grams, valid, width)
            seeds = np.unique(least[whole])
            seeds = seeds[_among(grams[seeds], index.prints[m])[0]]
            starts = np.unique((seeds[:, None] - np.arange(width)[None, :]).ravel())
            starts = starts[starts >= 0]
            starts = starts[starts <= limit[starts]]
        else:
            starts = np.flatnonzero(np.arange(len(row)) <= limit)
        if not len(starts):
            continue
        found, where = _among(W.run_hash(prepared, starts, starts + m), keys)
        starts, where = starts[found], where[found]
        np.add.at(step, starts, 1)
        np.add.at(step, starts + m, -1)
        pairs = np.unique(np.stack([row[starts], where], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
        n = at[pairs[:, 1] + 1] - at[pairs[:, 1]]
        take = np.repeat(at[pairs[:, 1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows.append(np.repeat(pairs[:, 0], n))
        items.append(item[take])
    hit = np.cumsum(step[:-1]) > 0
    if not rows:
        return hit, np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], 1), axis=0)
    return hit, both[:, 0], both[:, 1]


def _ranges(mask: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()


def _scan(documents: DataFrame, index: Index, keep: str) -> DataFrame:
    """The kept columns, n_words, spans and items, by an index that goes with the tasks."""
    shared = documents.sparkSession.sparkContext.broadcast(index)  # a block, so of bounded size
    kept = [x.split()[0] for x in keep.split(", ")]

    def scan(batch: pa.RecordBatch):
        index = shared.value
        names = np.array(index.ids, object)
        for chunk in W.chunks(batch.column("text"), W.NOT_ALNUM, True):
            hit, rows, items = _hits(chunk, index)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[chunk.first[1:]] - total[chunk.first[:-1]]
            bounds = np.searchsorted(rows, np.arange(chunk.rows + 1))
            spans = [_ranges(hit[a:b]) if n else [] for a, b, n in zip(chunk.first[:-1], chunk.first[1:], n_hit, strict=True)]
            found = [names[items[a:b]].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield {k: batch.column(k).slice(chunk.row, chunk.rows) for k in kept} | {"n_words": chunk.counts, "spans": spans, "items": found}

    return T.map_batches(documents, scan, keep + ", n_words long, spans array<int>, items array<string>")


#: Places that a fingerprint or a window of the benchmark is in, so that a frequent one does not gather in a task.
PLACES = 16
_TEXT = ["_h1", "_h2"]


def _windows(chunk: W.Chunk, sizes, window: int, gram: int):
    """(size, row, first word, fingerprint, hash) of the windows of some sizes: the whole ones, and those of short items."""
    row, place = chunk.row_of_word(), np.arange(len(chunk.hash))
    prepared = W.runs(chunk.hash, _SPAN) if len(row) else None
    for m in sizes if len(row) else ():
        starts = place[place + m <= chunk.first[1:][row]]
        if not len(starts):
            continue
        spans = W.run_hash(prepared, starts, starts + m)
        marks = spans
        if m == window:
            grams, valid = chunk.grams(gram)
            least, _ = W.winnow(grams, valid, window - gram + 1)
            marks = grams[least[starts]]
        yield m, row[starts], starts, marks, spans


def _placed(table: DataFrame, column: str = "_h1") -> DataFrame:
    return table.withColumn("place", F.pmod(F.col(column), F.lit(PLACES)))


def _everywhere(table: DataFrame) -> DataFrame:
    return table.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PLACES - 1).cast("long"))))


def _joined(documents: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """_h1, _h2 (of a text), copies, spans, items of the texts that hold a window of the benchmark."""

    def of_items(batch: pa.RecordBatch):
        for chunk in W.chunks(batch.column("text"), W.NOT_ALNUM, True):
            ids = {k: batch.column(k).slice(chunk.row, chunk.rows).to_numpy(zero_copy_only=False) for k in ("item", "item_id")}
            for m in np.unique(np.minimum(chunk.counts[chunk.counts > 0], window)).tolist():
                for _, row, _, marks, spans in _windows(chunk, (m,), window, gram):
                    mine = np.minimum(chunk.counts[row], window) == m
                    yield {"m": np.full(int(mine.sum()), m), "mark": marks[mine], "span": spans[mine], **{k: v[row[mine]] for k, v in ids.items()}}

    items = T.written(benchmark.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"))
    known = T.written(T.map_batches(items, of_items, "m int, mark long, span long, item long, item_id string").distinct())
    sizes = sorted(r["m"] for r in known.select("m").distinct().collect())  # ten at most

    def seeds(batch: pa.RecordBatch):
        ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in _TEXT]
        for chunk in W.chunks(batch.column("text"), W.NOT_ALNUM, True):
            for m, row, _, marks, _ in _windows(chunk, sizes, window, gram):
                new = np.append(True, (marks[1:] != marks[:-1]) | (row[1:] != row[:-1]))
                at = chunk.row + row[new]
                yield {"m": np.full(int(new.sum()), m), "mark": marks[new], "_h1": ids[0][at], "_h2": ids[1][at]}

    docs = documents.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2"))
    marks = T.map_batches(docs, seeds, "m int, mark long, _h1 long, _h2 long").distinct()
    met = _placed(marks).join(_everywhere(known.select("m", "mark").distinct()).hint("merge"), ["m", "mark", "place"]).select(*_TEXT, "mark")
    wanted = T.written(met.groupBy(*_TEXT).agg(F.collect_set("mark").alias("marks")))  # of one text

    def around(batch: pa.RecordBatch):
        ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in _TEXT]
        values, of = T.list_items(batch.column("marks"))
        for chunk in W.chunks(batch.column("text"), W.NOT_ALNUM, True):
            mine = (of >= chunk.row) & (of < chunk.row + chunk.rows)
            pairs = W.mix(values[mine].view(np.uint64) + of[mine].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for m, row, starts, marks, spans in _windows(chunk, sizes, window, gram):
                take = np.isin(W.mix(marks + (row + chunk.row).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), pairs)
                row = row[take]
                at = chunk.row + row
                yield {"m": np.full(len(at), m), "span": spans[take], "first": starts[take] - chunk.first[row], "_h1": ids[0][at], "_h2": ids[1][at]}

    copies = docs.groupBy(*_TEXT).agg(F.count("*").alias("copies"))
    texts = docs.join(T.written(wanted).hint("merge"), _TEXT).dropDuplicates(_TEXT)
    spans = T.map_batches(texts, around, "m int, span long, first int, _h1 long, _h2 long")
    hits = T.written(_placed(spans).join(_everywhere(known.select("m", "span").distinct()).hint("merge"), ["m", "span", "place"]).drop("place"))
    named = _placed(hits.select("m", "span", *_TEXT).distinct()).join(_everywhere(known.select("m", "span", "item", "item_id").distinct()), ["m", "span", "place"])
    named = named.select(*_TEXT, "item", "item_id").distinct().groupBy(*_TEXT).agg(F.collect_list("item_id").alias("items"))
    where = hits.select(*_TEXT, "first", "m").distinct().groupBy(*_TEXT).agg(F.array_sort(F.collect_list(F.struct("first", "m"))).alias("at"))

    def united(batch: pa.RecordBatch):
        out = []
        for found in batch.column("at").to_pylist():
            spans: list[int] = []
            for x in found:
                if spans and x["first"] <= spans[-1]:
                    spans[-1] = max(spans[-1], x["first"] + x["m"])
                else:
                    spans += [x["first"], x["first"] + x["m"]]
            out.append(spans)
        yield {"_h1": batch.column("_h1"), "_h2": batch.column("_h2"), "spans": out}

    merged = T.map_batches(where, united, "_h1 long, _h2 long, spans array<int>").join(named, _TEXT)
    return T.written(merged.join(copies, _TEXT))


@T.tidy
def marked(
    documents: DataFrame, benchmark: DataFrame, keep: str = "doc_id long", window: int = WINDOW, gram: int = GRAM, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Each document's kept columns, n_words, n_hit, spans (hit words, first and after, flat), items (ids, sorted as strings)."""
    kept = [x.split() for x in keep.split(", ")]
    columns = [c for c, _ in kept]
    docs = documents.select(*[F.col(c).cast(kind).alias(c) for c, kind in kept if c != "text"], "text")
    size = benchmark.agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars")).first()
    if size["items"] <= block_items and (size["chars"] or 0) <= block_chars:
        rows = benchmark.select("item_id", "text").collect()  # no larger than a block
        index = Index(["" if r["item_id"] is None else str(r["item_id"]) for r in rows], [r["text"] or "" for r in rows], window, gram)
        found = _scan(docs, index, keep)
    else:
        hits = _joined(docs, benchmark, window, gram)
        n = F.coalesce(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")), F.lit(0)).cast("long")
        named = docs.select(F.struct(*columns, n.alias("n_words")).alias("_row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("_h2"))
        none = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<string>)")
        found = T.hot_joined(named, hits, _TEXT, "copies", "left").select("_row.*", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    n = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(*columns, "n_words", n.alias("n_hit"), "spans", F.array_sort("items").alias("items"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = marked(T.read(spark, sf_dir, "documents"), T.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS h
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS h
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.h = bw.h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
