"""Readers for extracted documents, dumps and dialogue files.  Spark's codecs open .gz and .bz2 by themselves."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import foreign
from ..functions.cleaning import flatten_paragraphs, squeeze

MESSAGES = "array<struct<role:string,content:string>>"
DOCUMENT = "id string, title string, content string, hash string, source_file string"
DIALOGUE = f"id string, category string, language string, stage string, messages {MESSAGES}"
NODE = "id string, node_type string, labels map<string,string>, metadata map<string,string>"
FACT = "subject_id string, relation_id string, object_id string, metadata map<string,string>"
RELATION = "id string, subject_type string, object_type string"
TEMPLATE = f"id string, category string, language string, relation_id string, messages {MESSAGES}"
INDEX = "path string, tokens long"


def text(spark: SparkSession, path) -> DataFrame:
    """content, source_file: a file is a row."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source_file"))


def json(spark: SparkSession, path, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)


def jsonl(spark: SparkSession, path, schema, mode: str = "FAILFAST", recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped.  A malformed line raises, or with DROPMALFORMED is left out."""
    reader = spark.read.schema(schema).option("mode", mode).option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).json(path)


def jsonl_reported(spark: SparkSession, path, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """The same with the malformed lines in column ``malformed`` and the file in ``source_file``."""
    reader = spark.read.schema(f"{schema}, malformed string").option("columnNameOfCorruptRecord", "malformed").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("source_file"))


def csv(spark: SparkSession, path) -> DataFrame:
    """A header, and every value a string."""
    return spark.read.csv(path, header=True, inferSchema=False)


def html(spark: SparkSession, path) -> DataFrame:
    """content, source_file: the text of HTML files."""
    return text(spark, path).withColumn("content", foreign.html_text("content"))


def yaml(path: str, of_text: bool = False):
    """Driver-side configuration, from a file or from its text."""
    import yaml as library

    if of_text:
        return library.safe_load(path)
    with open(path, encoding="utf-8") as f:
        return library.safe_load(f)


def _lines(spark: SparkSession, path, schema: str = "content string", **options) -> DataFrame:
    return jsonl(spark, path, schema, **options)


def _settings(spark: SparkSession, path) -> DataFrame:
    import json as library

    found = yaml("".join(r["value"] + "\n" for r in spark.read.text(path).collect()), of_text=True)  # a configuration
    return spark.createDataFrame([(library.dumps(found, ensure_ascii=False, sort_keys=True),)], "content string")


READERS: dict[str, Callable] = {".txt": text, ".json": json, ".jsonl": _lines, ".csv": csv, ".html": html, ".htm": html, ".yaml": _settings, ".yml": _settings}
CODECS = (".gz", ".bz2", ".xz", ".lzma", ".zip")


def register(suffix: str, reader: Callable) -> None:
    if suffix in READERS:
        raise ValueError(f"a reader for {suffix!r} is there already")
    READERS[suffix] = reader


def files(spark: SparkSession, paths, seed: int | None = None) -> DataFrame:
    """path, size of the files that paths and patterns name, each once, in order of the path; with a seed, in that of a hash.

    The files are not opened.  No file at all raises."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", F.col("length").alias("size")).dropDuplicates(["path"])
    if not found.head(1):
        raise FileNotFoundError(f"no files: {paths}")
    return found.orderBy("path") if seed is None else found.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "path")), "path")


def contents(spark: SparkSession, path, field: str = "content") -> DataFrame:
    """One column of JSON lines, where it is a text; malformed lines are left out."""
    return spark.read.schema(f"`{field}` string").option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path).filter(F.col(field).isNotNull())


def vocab(spark: SparkSession, path: str) -> DataFrame:
    """token_id, token of a file of a token a line, as ``writers.vocab`` writes it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    spelled = F.col("value")
    for plain, coded in (("\x00", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\\", "\x00")):
        spelled = F.replace(spelled, F.lit(coded), F.lit(plain))
    return lines.select((F.row_number().over(Window.orderBy("f", "b", "i")) - 1).cast("long").alias("token_id"), spelled.alias("token"))  # a vocabulary


def benchmark(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    """The manifest of a benchmark's folder and its rows: id, category, language, messages, meta (all other fields, as JSON text).

    Data files are named relative to the folder.  A row without a required field, without messages, of an unknown role,
    or whose last turn is not the user's raises."""
    import json as library

    manifest = library.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/benchmark.json").collect()))  # one small file
    lines = spark.read.text([f"{folder}/{x}" for x in manifest["data_files"]]).filter(F.trim("value") != "")
    return manifest, parsed_examples(lines, "value")


def parsed_examples(lines: DataFrame, column: str) -> DataFrame:
    every = F.from_json(column, "map<string,string>")
    rows = lines.select(F.col(column).alias("line"), every.alias("m")).withColumn("messages", F.from_json(F.element_at("m", "messages"), MESSAGES))
    for name in ("id", "category", "language"):
        rows = rows.withColumn(name, F.try_element_at("m", F.lit(name)))
    roles = F.transform("messages", lambda x: x["role"])
    wrong = (
        F.when(F.col("m").isNull(), "invalid JSON")
        .when(F.col("id").isNull() | F.col("category").isNull() | F.col("language").isNull() | F.try_element_at("m", F.lit("messages")).isNull(), "a field is missing")
        .when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "no messages")
        .when(F.exists("messages", lambda x: x["role"].isNull() | x["content"].isNull()), "a message without role or content")
        .when(F.exists(roles, lambda x: ~x.isin("user", "assistant", "system")), "unknown role")
        .when(F.try_element_at(roles, F.lit(-1)) != "user", "the last turn is not the user's")
    )
    bad = F.raise_error(F.concat(wrong, F.lit(": "), F.left("line", F.lit(200)))).cast("boolean")
    rows = rows.filter(F.when(wrong.isNotNull(), bad).otherwise(F.lit(True)))
    meta = F.map_filter("m", lambda k, _: ~k.isin("id", "category", "language", "messages"))
    return rows.select("id", "category", "language", "messages", meta.alias("meta"))


def by_suffix(spark: SparkSession, path: str, **options) -> DataFrame:
    """The reader of a path's suffix, a codec's suffix aside; an unknown one raises.

    Spark opens .gz and .bz2; for the other codecs the text of the files is unpacked, and read as text."""
    name = path.lower()
    codec = next((c for c in CODECS if name.endswith(c)), "")
    name = name.removesuffix(codec)
    for suffix, reader in READERS.items():
        if name.endswith(suffix):
            return reader(spark, path, **options) if codec in ("", ".gz", ".bz2") else compressed(spark, path)
    raise ValueError(f"no reader for {path!r}")


def unpacked(data: bytes, name: str) -> bytes:
    """The bytes within a compressed file; of a zip file its first member."""
    name = name.lower()
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read(z.namelist()[0])
    for suffix, f in ((".gz", gzip.decompress), (".bz2", bz2.decompress), (".xz", lzma.decompress), (".lzma", lzma.decompress)):
        if name.endswith(suffix):
            return f(data)
    return data


def compressed(spark: SparkSession, path, encoding: str = "utf-8") -> DataFrame:
    """content, source_file of files under any of the codecs, those that Spark does not know among them.

    A file is a row, read whole by its task; a file beyond what a row can hold (2 GB) fails.  Dumps under .gz or .bz2 are
    better read by ``wiki_dump`` or Spark's text reader, which unpack them as a stream."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            yield pd.DataFrame({"content": [unpacked(d, p).decode(encoding, "replace") for d, p in zip(x["content"], x["path"], strict=True)], "source_file": x["path"]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, "content string, source_file string")


def wiki_dump(spark: SparkSession, path, most: int | None = None) -> DataFrame:
    """id, title, content, hash, source_file of a dump's pages that have a title and a text."""
    schema = "id string, title string, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", True).option("attributePrefix", "_a_").option("valueTag", "_VALUE")
    pages = pages.schema(schema).load(path).select("id", "title", F.col("revision.text._VALUE").alias("content"), F.input_file_name().alias("source_file"))
    pages = pages.filter(F.coalesce(F.col("title"), F.lit("")) != "").filter(F.coalesce(F.col("content"), F.lit("")) != "")
    pages = pages.select("id", "title", "content", F.md5("content").alias("hash"), "source_file")
    return pages.limit(most) if most is not None else pages


def subtitles(spark: SparkSession, root: str) -> DataFrame:
    """Latin-1 text files below a folder: named by the hash of their path, line ends as line feeds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    content = F.trim(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n"))
    relative = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").rpartition("/")[2] + "/", "")
    docs = files.select(F.md5(relative.cast("binary")).alias("id"), foreign.titles(F.regexp_extract(F.col("path"), "([^/]+)\\.txt$", 1)).alias("title"), content.alias("content"), relative.alias("source_file"))
    return docs.filter("content <> ''").select("id", "title", "content", F.md5(F.encode("content", "UTF-8")).alias("hash"), "source_file")


def web_corpus(rows: DataFrame, column: str = "text", lang: str = "pt", least: int = 100, most: int | None = None) -> DataFrame:
    """id, lang, content of squeezed texts; nested paragraphs are flattened."""
    nested = dict(rows.dtypes)[column].startswith("struct")
    flat = flatten_paragraphs(F.col(f"{column}.paragraphs")) if nested else F.col(column)
    docs = rows.select(F.lit(lang).alias("lang"), squeeze(flat).alias("content")).filter(F.length("content") >= least)
    docs = docs.select(F.sha2("content", 256).alias("id"), "lang", "content")
    return docs.limit(most) if most is not None else docs


def public_domain(spark: SparkSession, path, source: str, least: int = 100, names=("identifier", "file_id", "id")) -> DataFrame:
    """id, lang, source, content of Parquet files: only the text and the first of the named columns are read."""
    files = spark.read.parquet(path)
    named = next((n for n in names if n in files.columns), None)
    docs = files.select(squeeze(F.col("text")).alias("content"), (F.col(named).cast("string") if named else F.lit(None).cast("string")).alias("name")).filter(F.length("content") >= least)
    return docs.select(F.sha2(F.coalesce(F.nullif("name", F.lit("")), F.col("content")), 256).alias("id"), F.lit("pt").alias("lang"), F.lit(source).alias("source"), "content")


def packed_index(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema(INDEX).option("mode", "FAILFAST").json(paths)


def dialogues(spark: SparkSession, root: str, category: str | None = None) -> DataFrame:
    return jsonl_reported(spark, root, DIALOGUE, f"{category}_*.jsonl" if category else "*.jsonl")


def knowledge(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, relations and facts of a folder; malformed lines and missing fields raise."""
    read = lambda name, schema: jsonl(spark, f"{folder}/{name}.jsonl", schema)
    return required(read("nodes", NODE), "id", "node_type"), required(read("relations", RELATION), "id", "subject_type", "object_type"), required(read("facts", FACT), "subject_id", "relation_id", "object_id")


def required(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing field: {c}")).cast("string")).otherwise(F.col(c)))
    return rows
