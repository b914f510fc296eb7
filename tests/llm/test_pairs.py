"""Near duplicates, shared passages, benchmark spans: against brute force, SQL, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, ngram_join, substring_dedup, tables
from corpusloom.llm.components import components

from .helpers import ODD, same


def copies(seed, n=40):
    r = random.Random(seed)
    base = [[f"w{r.randrange(900)}" for _ in range(r.randint(3, 90))] for _ in range(6)]
    docs = []
    for k in range(n):
        x = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            at = r.randrange(len(x))
            x[at : at + r.randrange(2)] = [f"v{r.randrange(900)}"]
        docs.append((k, " ".join(x)))
    return docs


def brute(docs, shingle, percent):
    sets = {}
    for k, t in docs:
        w = (t or "").translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})).encode().split()
        sets[k] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("shingle,percent,nodes", [(4, 85, 256), (5, 80, 4), (2, 60, 3)])
def test_join_equals_brute_force(spark, monkeypatch, shingle, percent, nodes):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)  # small blocks, so that groups span several
    monkeypatch.setattr(ngram_join, "QUERIES", 2)
    docs = copies(shingle)
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, node int")
    found = {r["_key"]: (r["n_shingles"], r["component"]) for r in ngram_join.similar(df, shingle, percent).collect()}
    assert found == brute(docs, shingle, percent)


def test_frequent_shingles_come_last(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_SEEN", 3)
    monkeypatch.setattr(ngram_join, "LEAST_IN_TASK", 2)
    monkeypatch.setattr(ngram_join, "SHARED", 2)
    docs = [(k, f"{t} the same line ends every one of these texts") for k, t in copies(9)]
    found = {r["_key"]: (r["n_shingles"], r["component"]) for r in ngram_join.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == brute(docs, 4, 85)


def test_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar(empty).count() == 0
    rows = ngram_join.similar(spark.createDataFrame(ODD, "doc_id long, text string")).collect()
    assert len(rows) == len(ODD)
    by = {r["_key"]: r for r in rows}
    assert by[8]["n_shingles"] == 0 and by[8]["component"] == 8 and by[11]["component"] == 10 and by[12]["n_shingles"] == 1


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root}


def test_join_on_table(spark, data):
    same(ngram_join.op1_ngram_join(spark, data), ngram_join.ORACLE, data)


def test_passages_on_table(spark, data):
    same(substring_dedup.op9_substring_dedup(spark, data), substring_dedup.ORACLE, data)


def test_benchmark_on_table(spark, data):
    same(decontamination.op5_decontaminate(spark, data), decontamination.ORACLE, data)


def removed(docs, window):
    first = {}
    words = [(k, (t or "").encode().split()) for k, t in docs]
    order = lambda k: 1 << 63 if k is None else k
    for k, w in words:
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, order(k)), order(k))
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(k):
                gone |= set(range(i, i + window))
        out.append((order(k), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("window,gram", [(6, 2), (9, 4), (50, 8)])
def test_passages_equal_brute_force(spark, window, gram):
    r = random.Random(window)
    passages = [[f"p{r.randrange(40)}" for _ in range(r.randint(window - 2, 2 * window))] for _ in range(5)]
    docs = []
    for k in range(40):
        x = []
        for _ in range(r.randint(0, 4)):
            x += [f"u{r.randrange(30)}" for _ in range(r.randint(0, 7))] + r.choice(passages)[r.randrange(3) :]
        docs.append((k, " ".join(x)))
    docs += ODD + docs[:3]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, anchor string")
    found = sorted((x["doc_id"] if x["doc_id"] is not None else 1 << 63, x["n_words"], x["n_removed"], x["kept"]) for x in substring_dedup.removed_words(df, window, gram).collect())
    assert found == removed(docs, window)
    assert substring_dedup.removed_words(df.limit(0)).count() == 0


def test_counts_of_frequent_values():
    r, seen = np.random.default_rng(1), ngram_join._Seen(50)
    stream = [np.concatenate([r.integers(1000, 1 << 40, 60), np.arange(5)]).astype(np.uint64) for _ in range(400)]
    for part in stream:
        seen.add(part)
    seen.settle()
    found = dict(zip(seen.values.tolist(), seen.counts.tolist()))
    length = sum(map(len, stream))
    assert len(found) <= 50 and all(400 - 2 * length / 50 <= found[x] <= 400 or 400 <= 2 * length / 50 for x in range(5))
    assert {0, 1, 2, 3, 4} <= set(found)


def test_rows_without_doc_id_spread(spark):
    """A third of all rows have no doc_id, or the same one, and hold the same passages."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(12)]
    docs = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join([f"u{r.randrange(500)}" for _ in range(r.randrange(9))] + passage[r.randrange(4) :] + [f"v{k}"] * (k % 5))) for k in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted((x["doc_id"] if x["doc_id"] is not None else 1 << 63, x["n_words"], x["n_removed"], x["kept"]) for x in substring_dedup.removed_words(df, 6, 2).collect())
    assert found == removed(docs, 6)


def test_frequent_keys_travel(spark, monkeypatch):
    monkeypatch.setattr(tables, "LEAST_HOT", 3)
    monkeypatch.setattr(tables, "HOT", 2)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 9), (2, 5), (3, 4), (4, 1), (5, 2)) for i in range(n)], "k int, i int")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 5").withColumn("x", F.col("k") * 10)
    want = rows.join(table, "k").select("k", "i", "x").collect()
    assert sorted(tables.hot_joined(rows, table, ["k"], "n").select("k", "i", "x").collect()) == sorted(want)
    left = tables.hot_joined(rows, table, ["k"], "n", "left").select("k", "i", "x").collect()
    assert len(left) == 21 and sum(r["x"] is None for r in left) == 2


def test_written_tables_go(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "shared_folder", lambda _: str(tmp_path))
    docs = spark.createDataFrame(copies(4), "doc_id long, text string")
    held = ngram_join.similar(docs)
    held.count()
    left = list(tmp_path.glob("*/table-*"))
    assert {str(x) for x in left} == {x for x in tables._roots(held) if x.startswith(str(tmp_path))}
    assert 0 < len(left) <= 4


def test_blocks_of_the_benchmark(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "benchmark"))
    items = items.unionByName(spark.createDataFrame([(900, "ed the"), (901, None), (902, "!!"), (None, "of the")], "item_id long, text string"))
    docs = docs.unionByName(spark.createDataFrame([(k, t, "en", None, 0) for k, t in ODD], docs.schema))
    one, many = (sorted(map(str, decontamination.marked(docs, items, block_items=n).collect())) for n in (1000, 7))
    assert one == many
    assert decontamination.marked(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.marked(docs.limit(0), items).count() == 0


def test_a_large_benchmark_stays_a_table(spark, data, monkeypatch):
    """Beyond a block no index is made, and the driver takes no item."""
    docs, items = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "benchmark"))
    many = items.unionByName(spark.range(3000).select(F.col("id") + 10_000, F.concat(F.lit("filler "), F.expr("repeat(cast(id as string), 3)"), F.lit(" of no document at all, whatever its number is"))).toDF("item_id", "text"))
    want = sorted(map(str, decontamination.marked(docs, many).collect()))

    def never(*_):
        raise AssertionError("an index of a large benchmark")

    monkeypatch.setattr(decontamination, "Index", never)
    assert sorted(map(str, decontamination.marked(docs, many, block_items=1000).collect())) == want
