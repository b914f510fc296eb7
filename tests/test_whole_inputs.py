"""Plans on inputs that the given tables do not have, against their SQL."""

import duckdb
from pyspark.sql import functions as F

from corpusloom.functions import tokens
from corpusloom.plans import registry


def both(spark, folder, name):
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    theirs = c.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(theirs)


def test_leak_contains_finds_short_items(spark, tmp_path):
    docs = [(1, "What is the capital of France? Paris, of course, as one says. And so on it goes."), (2, "overheard: paris"), (3, ""), (4, None), (5, "the  end"), (6, "a b c d e f g h i j"), (7, "bathe end")]
    texts = ["Paris", "of course", "the end", "is the capital", "b c d e", "c d e f g", "d e f g h i", "b c d e f g h", "at", "e e", "", " ", "  ", None, "nowhere", "no such words", "What is the capital of", "is the capital of France? Paris, of"]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mine, theirs = both(spark, tmp_path, "leak_contains")
    assert mine == theirs and len(mine) >= 13


def test_sft_labels_of_a_long_dialogue(spark, data, tmp_path):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    first = turns.agg(F.min("conv_id")).first()[0]
    text = F.when(F.col("conv_id") == first, F.expr("repeat('word ', 1500)")).otherwise(F.col("text"))
    turns.withColumn("text", text).write.parquet(f"{tmp_path}/conversations.parquet")
    mine, theirs = both(spark, tmp_path, "sft_labels")
    assert mine == theirs and max(r[1] for r in mine) > 2048


def test_many_merges_a_pass_equal_one_by_one(spark, monkeypatch):
    counts = {w: 1 + i * i % 7 for i, w in enumerate("the then thesis banana bandana aaaa aaaaa sing singing king xyz zyx ox fox foxes".split())}
    words, want = {w: list(w) for w in counts}, []
    for _ in range(25):
        pairs = {}
        for w, s in words.items():
            for x in zip(s, s[1:]):
                pairs[x] = pairs.get(x, 0) + counts[w]
        if not pairs:
            break
        a, b = min(pairs, key=lambda x: (-pairs[x], x))
        want.append((a, b, pairs[a, b]))
        for s in words.values():
            i = 0
            while i < len(s) - 1:
                if (s[i], s[i + 1]) == (a, b):
                    s[i : i + 2] = [a + b]
                i += 1
    passes, real = [], tokens.apart_enough
    monkeypatch.setattr(tokens, "apart_enough", lambda *a: passes.append(real(*a)) or passes[-1])
    assert tokens.train_merges(spark.createDataFrame(list(counts.items()), "token string, freq long"), 25) == want
    assert len(passes) < len(want)
