"""Operators without a query of their own, orders over skewed tables, and what must raise."""

import json
import logging
import lzma
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import answers, cleaning, generation, sentences, tokens
from corpusloom.operators import dialogues, evaluation, knowledge, packing, ranges
from corpusloom.sources import readers, writers
from corpusloom.streaming import training


def skewed(n=900):
    """A third of all rows share a key, a third have none."""
    return [(7 if k % 3 == 0 else None if k % 3 == 1 else 5 * k, k) for k in range(n)]


@pytest.mark.parametrize("each", [10_000, 40])
def test_offsets_of_skewed_keys(spark, each):
    df = spark.createDataFrame([(key, k, k % 11) for key, k in skewed()], "doc_id long, k long, n long")
    rows = packing.offsets(df, F.col("n"), bucket=each).collect()
    order = sorted(rows, key=lambda r: (r["start"], r["n"]))
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n"]
    keys = [r["doc_id"] if r["doc_id"] is not None else 1 << 63 for r in sorted(rows, key=lambda r: r["start"]) if r["n"]]
    assert keys == sorted(keys) and at == sum(k % 11 for _, k in skewed())


def test_a_hot_key_fills_several_ranges(spark):
    df = spark.createDataFrame([(key or 0, k) for key, k in skewed()], "key long, k long")
    found = ranges.ranged(df, "key", F.xxhash64("k"), each=30).groupBy("_range").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("_range").collect()
    assert max(r["n"] for r in found) < 120 and len(found) > 15
    assert all(a["high"] <= b["low"] for a, b in zip(found, found[1:]))


def test_numbers_within_groups(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, i long")
    placed = ranges.numbered(ranges.ranged(df, "i", F.xxhash64("i"), each=20), ["i"], ("g",)).collect()
    for g in ("a", "b", None):
        assert [x["place"] for x in sorted((x for x in placed if x["g"] == g), key=lambda x: x["i"])] == list(range(1, 1 + sum(d[0] == g for d in data)))


def test_next_fit_of_batches(spark):
    """Folded from sorted batches, the same as over each part's whole list."""
    r = random.Random(2)
    df = spark.createDataFrame([(i, r.randint(1, 70)) for i in range(700)], "id long, size int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    rows = packing.packed(df, 64, parts=3).join(df.select(F.col("id").alias("i"), F.md5(F.concat_ws(":", F.lit("0"), F.col("id").cast("string"))).alias("o")), F.col("id") == F.col("i")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for part in range(3):
        mine = sorted((x for x in rows if x["part"] == part), key=lambda x: x["o"])
        assert [x["sequence"] for x in mine] == packing.next_fit([x["size"] for x in mine], 64)
        for s in {x["sequence"] for x in mine}:
            assert [x["segment"] for x in mine if x["sequence"] == s] == list(range(sum(x["sequence"] == s for x in mine)))


def test_many_ranges_keep_the_order(spark):
    df = spark.range(6000).select((F.col("id") * 7).alias("key"))
    found = ranges.ranged(df, "key", F.xxhash64("key"), each=2).groupBy("_range").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("_range").collect()
    assert len(found) > 2500 and found[-1]["_range"] > 1 << 31
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:], strict=False))


def test_spikes_of_one_long_run(spark):
    r = random.Random(3)
    log = [("a", i, r.choice([1.0, 1.2, 9.0, float("nan")])) for i in range(400)] + [("b", i, 2.0) for i in range(30)] + [("b", 99, 50.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "19")
    found = sorted((x["run"], x["step"], x["reason"]) for x in training.spikes(spark.createDataFrame(log, "run string, step long, loss double")).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for run in "ab":
        d = training.Detector()
        want += [(run, step, why) for name, step, loss in log if name == run and (why := d.feed(loss))]
    assert found == sorted(want)


def test_quick_patterns_match_alike(spark, data):
    r = random.Random(4)
    texts = ["".join(r.choice("abÀé_1 ,;:!?\'\"AB.\n") for _ in range(60)) for _ in range(400)] + ["a,bc,de", "a,bcd,ef!gh", "x,ab\"cd,ef"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").unionByName(spark.read.parquet(f"{data}/documents.parquet").select(F.col("text").alias("t")))
    for slow, quick in cleaning._QUICK.items():
        assert df.filter(F.regexp_replace("t", *slow) != F.regexp_replace("t", *quick)).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("He met Dr. (Smith) today. It rained.", ["He met Dr. (Smith) today.", "It rained."]),
        ("On Jan. 5 he came. In Feb. Mary left.", ["On Jan. 5 he came.", "In Feb. Mary left."]),
        ("Is it? Yes! \"No.\" He left... Then ran.", ["Is it?", "Yes!", "\"No.\"", "He left...", "Then ran."]),
        ("See No. 5 of it. No. Then go.", ["See No. 5 of it.", "No.", "Then go."]),
        ("The U.S.A. Team won. e.g. This.", ["The U.S.A. Team won. e.g. This."]),
        ("one\ntwo\n\nthree", ["one", "two", "", "three"]),
        ("", []),
        (None, []),
    ],
)
def test_sentence_rules(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sentences.split_sentences(F.col("t"), F.lit("en")).alias("s")).first()["s"] == want


def test_prefix_files(spark):
    lines = ["# a list", "", "Abc", "Nr #NUMERIC_ONLY#", "Xy # why", "Xy #NUMERIC_ONLY#"]
    assert sentences.parse_prefixes(lines) == (["Abc"], ["Nr", "Xy"])
    df = spark.createDataFrame([("An Abc. Be it. Nr. 5 is. Nr. Five.",)], "t string")
    found = df.select(sentences.split_sentences(F.col("t"), F.lit("zz"), {"zz": sentences.parse_prefixes(lines)}).alias("s")).first()["s"]
    assert found == ["An Abc. Be it.", "Nr. 5 is.", "Nr.", "Five."]


def test_training_resumes(spark, tmp_path):
    words = {w: 1 + i % 5 for i, w in enumerate("the then thesis banana bandana sing singing king fox foxes lower lowest newest".split())}
    df = spark.createDataFrame(list(words.items()), "token string, freq long")
    whole = tokens.train_merges(df, 20)
    assert tokens.train_merges(df, 8, state=f"{tmp_path}/state") == whole[:8]
    assert tokens.load_state(spark, f"{tmp_path}/state") == whole[:8]
    assert tokens.train_merges(df, 20, state=f"{tmp_path}/state") == whole
    assert tokens.train_merges(df, 20, in_memory=3) == whole
    assert tokens.train_merges(df, 20, state=f"{tmp_path}/other", in_memory=3) == whole


def test_documents_are_encoded_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 3)  # several steps a batch
    vocab = tokens.vocabulary([("a", "b", 1), ("Ġ", "ab", 1)])
    texts = [(1, "ab ab b"), (1, "b"), (2, ""), (3, None), (None, "é ab"), (4, "ab" * 50)]
    found = tokens.encoded(spark.createDataFrame(texts, "doc_id long, text string"), vocab, keep=("text",))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r["doc_id"], r["text"], "".join(vocab[i] for i in r["ids"]), len(r["ids"])) for r in found.collect()]
    want = [(1, "ab ab b", "abĠabĠb", 4), (1, "b", "b", 1), (None, "é ab", "Ã©Ġab", 3), (4, "ab" * 50, "ab" * 50, 50)]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_all_ways_of_training_agree(spark, monkeypatch):
    r = random.Random(8)
    words = list({"".join(r.choice("aab") for _ in range(r.randrange(1, 12))) for _ in range(300)})
    df = spark.createDataFrame([(w, r.randrange(1, 9)) for w in words], "token string, freq long")
    square = tokens.train_merges(df, 40)
    monkeypatch.setattr(tokens, "SQUARE", 0)
    assert tokens.train_merges(df, 40) == square and len(square) == 40
    monkeypatch.setattr(tokens, "IN_HEAP", 0)
    assert tokens.train_merges(df, 6) == square[:6]


def test_tokens_that_cannot_be_encoded_raise(spark):
    df = spark.createDataFrame([(1, "ab zz")], "doc_id long, text string")
    with pytest.raises(Exception, match="no pieces"):
        tokens.encoded(df, ["a", "b", "Ġ"]).collect()
    with pytest.raises(Exception, match="not in"):
        df.select(tokens.in_range(F.array(F.lit(1), F.lit(9)), 9).alias("x")).collect()


def test_special_tokens(spark):
    vocab = spark.createDataFrame(list(enumerate(tokens.SPECIAL_TOKENS)), "token_id int, token string")
    assert tokens.resolve(vocab, {"pad": "<PAD>", "user": "<extra_10>"}) == {"pad": 0, "user": 15}
    with pytest.raises(KeyError, match="nowhere"):
        tokens.resolve(vocab, {"x": "nowhere"})


def test_masks_of_a_batch():
    masks = tokens.causal_masks(np.array([[0, 0, 1], [0, -1, -1]]))
    assert masks.shape == (2, 1, 3, 3) and masks[0, 0].tolist() == tokens.causal_mask(np.array([0, 0, 1])).tolist()
    assert tokens.causal_masks(np.zeros((0, 4), int)).shape == (0, 1, 4, 4)


def test_results_summaries_and_vocabularies(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    results, summary, vocab = (f"{tmp_path}/{x}" for x in ("results", "summary", "vocab"))
    writers.results(rows, results)
    writers.results(rows, results)
    writers.summary(rows.limit(1), summary)
    writers.summary(rows, summary)
    assert spark.read.json(results).count() == 4 and spark.read.json(summary).count() == 2
    writers.reset(spark, results, summary, f"{tmp_path}/nothing")
    assert not any((tmp_path / x).exists() for x in ("results", "summary"))
    odd = ["a", " ", "", "\n", "\r\n", "\\n", "Ġthe", "\\", "é\t"]
    writers.vocab(spark.createDataFrame(list(enumerate(odd)), "token_id int, token string"), vocab)
    assert [r["token"] for r in readers.vocab(spark, vocab).orderBy("token_id").collect()] == odd


def test_readers_by_suffix_and_codec(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"content": "x"}\n{"content": "y"}\n')
    (tmp_path / "b.yaml").write_text("k: [1, 2]\n")
    (tmp_path / "c.txt.xz").write_bytes(lzma.compress("é".encode()))
    (tmp_path / "d.jsonl").write_text('{"content": "x"}\n{broken\n{"content": 7}\n{"other": 1}\n')
    assert readers.by_suffix(spark, f"{tmp_path}/a.jsonl").count() == 2
    assert json.loads(readers.by_suffix(spark, f"{tmp_path}/b.yaml").first()["content"]) == {"k": [1, 2]}
    assert readers.by_suffix(spark, f"{tmp_path}/c.txt.xz").first()["content"] == "é"
    with pytest.raises(ValueError, match="no reader"):
        readers.by_suffix(spark, f"{tmp_path}/c.bin.xz")
    assert {r["content"] for r in readers.contents(spark, f"{tmp_path}/d.jsonl").collect()} <= {"x", "7"}
    found = [r["path"].rpartition("/")[2] for r in readers.files(spark, [f"{tmp_path}/*.jsonl", f"{tmp_path}/a.*"]).collect()]
    assert found == ["a.jsonl", "d.jsonl"]
    with pytest.raises(Exception, match="no files|PATH_NOT_FOUND|does not exist"):
        readers.files(spark, [f"{tmp_path}/*.none"]).collect()


@pytest.mark.parametrize(
    "line,why",
    [
        ("{", "invalid JSON"),
        ('{"id": "1", "category": "c", "language": "en"}', "missing"),
        ('{"id": "1", "category": "c", "language": "en", "messages": []}', "no messages"),
        ('{"id": "1", "category": "c", "language": "en", "messages": [{"role": "user"}]}', "without role or content"),
        ('{"id": "1", "category": "c", "language": "en", "messages": [{"role": "bot", "content": "x"}]}', "unknown role"),
        ('{"id": "1", "category": "c", "language": "en", "messages": [{"role": "assistant", "content": "x"}]}', "last turn"),
    ],
)
def test_benchmark_rows_that_raise(spark, line, why):
    with pytest.raises(Exception, match=why):
        readers.parsed_examples(spark.createDataFrame([(line,)], "value string"), "value").collect()


def test_arguments_and_logs(tmp_path):
    good = dict(categories=["turn_taking"], languages=["en"], batch_id="0002", batch_size=20, acceptance=0.7, safety=1.5, max_tokens=100, known_categories=dialogues.MESSAGE_COUNTS)
    generation.check_arguments(**good)
    for bad in ({"categories": ["x"]}, {"languages": ["fr"]}, {"batch_id": "2"}, {"batch_size": 0}, {"acceptance": 1.1}, {"safety": 0.5}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            generation.check_arguments(**{**good, **bad})
    log = generation.logger("test_pipeline", str(tmp_path), most_bytes=300)
    for i in range(9):
        log.info("line %d", i)
    log.debug("not this")
    files = sorted(tmp_path.glob("test_pipeline.jsonl*"))
    lines = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    assert len(files) > 1 and {x["message"] for x in lines} == {f"line {i}" for i in range(9)} and lines[0]["level"] == "INFO"
    logging.getLogger("test_pipeline").handlers.clear()


def test_schemas():
    ok = {
        "route": {"type": "route", "next_agent": "final", "blackboard_updates": {}, "why": ""},
        "action": {"type": "final", "tool": None, "args": {"a": 1}, "blackboard_updates": {}, "why": ""},
        "plan": {"type": "plan", "steps": [{"id": "1", "intent": "x", "done_when": "y"}], "blackboard_updates": {}, "why": ""},
        "eval": {"type": "eval", "decision": "retry", "blackboard_updates": {}, "why": ""},
        "retrieval": {"type": "retrieval", "query": "q", "top_k": 3, "chunks": [{"id": "1", "source": "s", "text": "t", "score": None}], "blackboard_updates": {}, "why": ""},
        "summary": {"type": "summary", "memory": "m", "keep": ["a"], "drop_before": None, "blackboard_updates": {}, "why": ""},
    }
    assert set(ok) == set(generation.SCHEMAS)
    for name, value in ok.items():
        schema = generation.SCHEMAS[name]
        assert generation.fault(value, schema) is None
        assert generation.fault([], schema).endswith("not of type object")
        for field in schema["required"]:
            assert generation.fault({k: v for k, v in value.items() if k != field}, schema) == f"{field}: missing"
        assert generation.fault({**value, "more": 1}, schema) == "more: not expected"
        assert generation.fault({**value, "why": "x" * 201}, schema) == "why: out of range"
    assert generation.fault({**ok["plan"], "steps": []}, generation.SCHEMAS["plan"]) == "steps: out of range"
    assert generation.fault({**ok["plan"], "steps": [{"id": "", "intent": "x", "done_when": "y"}]}, generation.SCHEMAS["plan"]) == "steps[0].id: out of range"
    assert generation.fault({**ok["retrieval"], "top_k": 11}, generation.SCHEMAS["retrieval"]) == "top_k: out of range"
    assert generation.fault({**ok["retrieval"], "top_k": True}, generation.SCHEMAS["retrieval"]) == "top_k: not of type integer"


def test_metrics_are_looked_up(spark):
    rows = spark.createDataFrame([("1", "c", "en", "no no no no"), ("2", "c", "en", "fine")], "id string, category string, language string, answer string")
    manifest = lambda *names: spark.createDataFrame([("c", n, "gate", []) for n in names], "category string, metric string, role string, expected_any array<string>")
    found = {r["id"]: r["failed_checks"] for r in evaluation.evaluated(rows, manifest("repetition", "not_empty")).collect()}
    assert found == {"1": ["repetition"], "2": []}
    with pytest.raises(ValueError, match="unknown metric"):
        evaluation.evaluated(rows, manifest("of_ours"))
    answers.register("of_ours", lambda answer: answers.result(F.length(answer) < 6))
    try:
        assert {r["id"]: r["passed"] for r in evaluation.evaluated(rows, manifest("of_ours")).collect()} == {"1": False, "2": True}
    finally:
        del answers.METRICS["of_ours"]


def test_partial_outputs_and_training_sets(spark):
    schema = "id string, category string, language string, stage string, messages array<struct<role:string,content:string>>"
    ok = [(str(i), "turn_taking", "en", "stage0", [("user", f"q{i}"), ("assistant", "a")]) for i in range(3)]
    assert dialogues.resumable(spark.createDataFrame(ok, schema), "turn_taking", "en").count() == 3
    with pytest.raises(ValueError, match="duplicate_content"):
        dialogues.resumable(spark.createDataFrame([*ok, ("9", *ok[0][1:])], schema), "turn_taking", "en")
    rows = spark.createDataFrame([(*x, None) for x in ok], schema + ", malformed string")
    assert dialogues.checked(rows).count() == 3
    with pytest.raises(RuntimeError, match="1 of 4"):
        dialogues.checked(rows.unionByName(rows.limit(1).withColumn("malformed", F.lit("{"))))
    with pytest.raises(FileNotFoundError):
        dialogues.checked(rows.limit(0))


def test_graphs_that_raise(spark):
    nodes = spark.createDataFrame([("a", "x", {"en": "A"}, {"g": "m"}), ("b", "y", {"en": "B"}, {"g": "m"})], "id string, node_type string, labels map<string,string>, metadata map<string,string>")
    relations = spark.createDataFrame([("r", "x", "y")], "id string, subject_type string, object_type string")
    facts = spark.createDataFrame([("a", "r", "b")], "subject_id string, relation_id string, object_id string")
    assert knowledge.KnowledgeBase(nodes, relations, facts).facts.count() == 1
    with pytest.raises(Exception, match="object_type|subject_type"):
        knowledge.KnowledgeBase(nodes, relations, spark.createDataFrame([("b", "r", "a")], facts.schema)).facts.collect()
    with pytest.raises(Exception, match="not there"):
        knowledge.looked_up(nodes, spark.createDataFrame([("z",)], "id string"), ["id"]).collect()
    with pytest.raises(ValueError, match="equal id"):
        knowledge.built([knowledge.StaticBuild("s"), knowledge.StaticBuild("s")], None, nodes)


def test_weights():
    with pytest.raises(ValueError, match="zero"):
        generation.weighted(F.lit("00"), {"a": 0.0, "b": -1.0})


def test_a_shared_folder_is_asked_for():
    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        writers.shared_folder(Session)
