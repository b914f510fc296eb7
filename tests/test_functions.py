"""Column functions against plain Python, with the cases the tables lack."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import answers, cleaning, filtering, foreign, sentences, tokens
from corpusloom.operators import dialogues, knowledge, packing
from corpusloom.streaming.training import Detector


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "step,text,want",
    [
        ("control", "a\nb\tc\x7f", "abc"),
        ("zero_width", "Hello​World﻿", "HelloWorld"),
        ("punct_spacing", "Hello,world!Today is sunny.", "Hello, world! Today is sunny."),
        ("space_before_punct", "Hello , world !", "Hello, world!"),
        ("open_quote", "don't say“x”", "don 't say “x”"),
        ("close_quote", "'x'y", "' x' y"),
        ("html_tags", "a <p><b>x</b> y", "a\n x y"),
        ("email", "Contact me at example@domain.com for", "Contact me at  <EMAIL>  for"),
        ("hashtag", "@user #Python", " <HASHTAG>   <HASHTAG> "),
        ("citations", "Smith [1], see also [2], [345].", "Smith, see also."),
        ("seg_basic", " greatStop there.", " great\nStop there."),
        ("seg_quotes", " said:'Watch out", " said:\n'Watch out"),
    ],
)
def test_cleaning(spark, step, text, want):
    assert column(spark, [text], cleaning.STEPS[step]) == [want]


def test_entropy(spark):
    texts = ["", "a", "aab", "é日本aa", "the quick brown fox"]
    want = [0.0 if not t else -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) for t in texts]
    assert np.allclose(column(spark, texts, filtering.entropy), want)


def test_reject_reasons(spark):
    good = "The rain fell on the small town. " * 10
    cases = [None, "", "short", "w" * 300, " ".join(["word"] * 60), "Aa. Bb. Cc. " + "a" * 300 + " a" * 40, good + "%&$#@!*()+" * 40, good + " " + "ab12" * 6, good]
    want = ["length", "length", "length", "word_count", "sentence_count", "entropy", "symbol_ratio", "garbage", None]
    assert column(spark, cases, lambda t: filtering.reject_reason(t, filtering.Limits(min_compression=None))) == want


def test_sentences(spark):
    text = 'Mr. Smith went home. He slept! "Why?" asked No. 5. U.S. troops left.'
    found = column(spark, [text], lambda t: sentences.split_sentences(t, F.lit("en")))[0]
    assert found[0] == "Mr. Smith went home." and found[1] == "He slept!" and len(found) >= 3
    assert " ".join(found) == text


def test_foreign():
    assert foreign.repaired("cafÃ©") == "café" and foreign.repaired("plain é") == "plain é"
    assert foreign.html_to_text("<p>a &amp; b<script>x</script></p>") == "a & b"
    assert foreign.wiki_to_text("{{a|{{b}}}}'''x''' [[y|z]] [[q]]") == "x z q"
    assert foreign.file_title("São Paulo: 2 (b)") == "Sao_Paulo_2_b"


def brute_loop(t):
    for size in range(len(t) // 2, 0, -1):
        least = 3 if size <= 2 else 2
        for start in range(len(t) - size * least + 1):
            n = 1
            while t[start + n * size : start + (n + 1) * size] == t[start : start + size]:
                n += 1
            if n >= least:
                return size, start, n
    return 0, 0, 0


def test_loops():
    r = random.Random(2)
    for _ in range(2000):
        t = [r.choice("abc") for _ in range(r.randrange(14))]
        assert answers.find_loop(t) == brute_loop(t), t
    assert answers.find_loop("no no thanks".split())[0] == 0
    assert answers.find_loop("the woman saw it coming the woman saw it coming".split()) == (5, 0, 2)


def test_pre_tokens_restore(spark):
    texts = ["", "\n", "   ", "A" * 100, "1234567890", "日本語 テスト", "disse-lhe don't", "a b\r\nc 😀", "fazê-los -os"]
    assert column(spark, texts, lambda t: F.array_join(tokens.pre_tokens(t), "")) == texts
    assert column(spark, texts, lambda t: tokens.byte_decode(tokens.byte_encode(t))) == texts


def test_merges_by_hand(spark):
    df = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3), ("aaaa", 1)], "token string, freq long")
    merges = [m[:2] for m in tokens.train_merges(df, 3)]
    assert merges == [("e", "s"), ("es", "t"), ("l", "o")]
    text = tokens.merge_pair(tokens.joined(tokens.splits(F.col("token"))), "a", "a")
    assert df.filter("token = 'aaaa'").select(tokens.apart(text).alias("s")).first()["s"] == ["aa", "aa"]


def test_longest_match(spark):
    assert tokens.longest_match("abcab", {"a", "ab", "abc", "b"}, 3) == ["abc", "ab"]
    assert tokens.longest_match("xab", {"a", "ab", "b"}, 2) == []


@pytest.mark.parametrize("n,length", [(0, 4), (4, 4), (5, 4), (8, 4), (9, 4), (11, 4)])
def test_windows(spark, n, length):
    found = spark.range(1).select(tokens.windows(F.array(*[F.lit(i) for i in range(n)]) if n else F.expr("cast(array() as array<int>)"), length).alias("w")).first()["w"]
    ids = list(range(n))
    assert found == [ids[i : i + length + 1] for i in range(0, n - length, length) if len(ids[i : i + length + 1]) == length + 1]


@pytest.mark.parametrize("left", [True, False])
def test_labels(spark, left):
    ids = {"user": 101, "assistant": 102, "system": 103, "eos": 104, "pad": 0}
    df = spark.createDataFrame([([("user", [1, 2]), ("assistant", [3])],)], "m array<struct<role:string,tokens:array<int>>>")
    x = df.select(tokens.sft_labels(F.col("m"), ids, 9, left=left).alias("x")).first()["x"]
    full, labels = [101, 1, 2, 104, 102, 3, 104], [-100, -100, -100, -100, 3, 104, -100]
    assert x["input_ids"] == ([0, 0] + full if left else full + [0, 0])
    assert x["labels"] == ([-100] * 2 + labels if left else labels + [-100] * 2)
    assert sum(x["attention_mask"]) == 7


def test_mask():
    m = tokens.causal_mask(np.array([0, 0, 1, -1]))
    assert m.tolist() == [[True, False, False, False], [True, True, False, False], [False, False, True, False], [False] * 4]


def test_next_fit():
    assert packing.next_fit([3, 4, 2, 9, 6, 1], 7) == [0, 0, 1, -1, 2, 2]


def test_offsets_in_many_buckets(spark):
    sizes = [(i * 3, (i * 7) % 11) for i in range(500)]
    placed = packing.offsets(spark.createDataFrame(sizes, "doc_id long, n long"), F.col("n"), bucket=20)
    at, want = 0, {}
    for k, n in sizes:
        want[k] = at
        at += n
    assert {r["doc_id"]: r["start"] for r in placed.collect()} == want


def test_validation(spark):
    ok = [("user", "a"), ("assistant", "b")]
    cases = [("turn_taking", "en", ok), ("nope", "xx", ok), ("turn_taking", "en", []), ("turn_taking", "en", [("user", " "), ("bot", "b")]), ("uncertainty", "pt", [("assistant", "<EOS>"), ("assistant", "<SPECIAL-7>"), ("user", "x")]), ("local_context", "pt", ok)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, l string, m array<struct<role:string,content:string>>")
    found = [r["e"] for r in df.select("i", dialogues.errors(F.col("c"), F.col("l"), F.col("m")).alias("e")).orderBy("i").collect()]
    assert found == [[], ["category", "language"], ["messages"], ["role", "content"], ["first", "last", "alternation", "forbidden"], ["message_count"]]


def test_conflicts_raise(spark):
    nodes = spark.createDataFrame([("a", "x"), ("a", "x")], "id string, t string")
    assert knowledge.unique(nodes, ["id"]).count() == 1
    with pytest.raises(Exception, match="conflict"):
        knowledge.unique(nodes.unionByName(spark.createDataFrame([("a", "y")], "id string, t string")), ["id"]).collect()
    with pytest.raises(Exception, match="no value"):
        spark.range(1).select(knowledge.substituted(F.lit("{x}"), F.create_map(F.lit("y"), F.lit("z")))).collect()


def test_detector():
    d = Detector()
    flags = [d.feed(x) for x in [1.0] * 12 + [float("nan"), 6.0, 1.0, 4.9, 7.0]]
    assert flags[:12] == [None] * 12 and flags[12] == "nan_or_inf" and flags[13] == "loss_spike" and flags[15] is None and flags[16] == "loss_spike"


def test_registries():
    with pytest.raises(ValueError):
        answers.register("repetition", answers.repetition)
