"""Streams with their state and checkpoints, readers of files under all codecs."""

import bz2
import gzip
import json
import lzma
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, writers
from corpusloom.streaming import ingest, training


def test_spikes_stream_equals_batch(spark, tmp_path):
    log = [("a", i, 1.0 + i % 3) for i in range(30)] + [("a", 30, 90.0), ("a", 31, 2.0), ("b", 1, float("inf")), ("b", 2, 3.0)]
    df = spark.createDataFrame(log, "run string, step long, loss double")
    want = sorted(map(tuple, training.spikes(df).collect()))
    df.filter("step < 20").coalesce(1).write.parquet(f"{tmp_path}/in/1.parquet")
    df.filter("step >= 20").coalesce(1).write.parquet(f"{tmp_path}/in/2.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = training.spike_stream(stream).writeStream.format("memory").queryName("spikes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select run, step, loss, reason from spikes").collect())) == want == [("a", 30, 90.0, "loss_spike"), ("b", 1, float("inf"), "nan_or_inf")]


def test_ingest_takes_files_once(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    source, target, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    df.write.parquet(source)
    for _ in range(2):
        ingest.ingest(spark, source, df.schema, target, cp)
    assert spark.read.parquet(target).count() == 10
    more = spark.range(5, 15).withColumn("x", F.col("id") * 2)
    ingest.ingest_new(spark, source, df.schema, f"{target}-new", f"{cp}-new", "id")
    more.write.mode("append").parquet(source)
    ingest.ingest_new(spark, source, df.schema, f"{target}-new", f"{cp}-new", "id")
    assert sorted(r["id"] for r in spark.read.parquet(f"{target}-new").collect()) == list(range(15))


def test_codecs(spark, tmp_path):
    raw = "olá\nmundo".encode()
    (tmp_path / "a.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "b.bz2").write_bytes(bz2.compress(raw))
    (tmp_path / "c.xz").write_bytes(lzma.compress(raw))
    (tmp_path / "d.lzma").write_bytes(lzma.compress(raw, lzma.FORMAT_ALONE))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x.txt", raw)
    rows = readers.compressed(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and {r["content"] for r in rows} == {"olá\nmundo"}


def test_readers(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id": "1", "category": "x"}\n\n{"id": "2"}\n{bad\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "rows.jsonl"), "id string").collect()
    assert readers.jsonl(spark, str(tmp_path / "rows.jsonl"), "id string", "DROPMALFORMED").count() == 2
    found = readers.jsonl_reported(spark, str(tmp_path), "id string", "rows.jsonl").cache()
    assert found.filter("malformed is not null").count() == 1
    (tmp_path / "one.json").write_text(json.dumps({"a": 1, "b": [1, 2]}, indent=2))
    assert readers.by_suffix(spark, str(tmp_path / "one.json")).first()["a"] == 1
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert readers.by_suffix(spark, str(tmp_path / "t.csv")).first().asDict() == {"a": "1", "b": "x"}
    (tmp_path / "p.html").write_text("<p>hi <b>you</b></p>")
    assert readers.by_suffix(spark, str(tmp_path / "p.html")).first()["content"] == "hi you"
    with pytest.raises(ValueError):
        readers.by_suffix(spark, "x.parq")


def test_subtitles(spark, tmp_path):
    root = tmp_path / "subs"
    (root / "m").mkdir(parents=True)
    (root / "m" / "São 1.txt").write_bytes("olá\r\nvocê ".encode("latin-1"))
    (root / "m" / "empty.txt").write_bytes(b"  ")
    rows = readers.subtitles(spark, str(root)).collect()
    assert len(rows) == 1 and rows[0]["content"] == "olá\nvocê"


def test_pinned(spark, tmp_path):
    df = spark.range(3)
    writers.pinned(df, f"{tmp_path}/d", dataset="a", tokenizer="t")
    writers.pinned(df, f"{tmp_path}/d", dataset="a", tokenizer="t")
    assert spark.read.parquet(f"{tmp_path}/d/data").count() == 6
    with pytest.raises(RuntimeError):
        writers.pinned(df, f"{tmp_path}/d", dataset="b", tokenizer="t")
