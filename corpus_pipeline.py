"""From documents to token files: the stages, in order, each over all that the one before kept.

1. quality classifier: documents scored below the threshold go;
2. n-gram Jaccard join (five words, 0.8): of each group of near duplicates, the
   document of the least doc_id stays;
3. benchmark decontamination: documents that hold a window of a benchmark item go;
4. mixing sources: each document is repeated as often as the mix takes it; what
   is left beyond whole copies is a copy of its first words;
5. token output: the ids are written, read back, and described by document.

The model of stage 1 is fitted on a bounded sample of labelled documents; the
labels and the benchmark are read from ``sf_dir``.  Repeated rows of one doc_id
are judged each by its own text.  Null texts and texts without words are empty
documents: stage 1 scores them, stage 2 links them with nothing, stage 4 takes
nothing of them.  Rows without a doc_id are documents too, the last ones in every
order.  Columns beyond those of documents are left out by the first stage.  An
empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, mixing, ngram_join, quality_classifier, tables, token_output

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = tuple(x.split()[0] for x in SCHEMA.split(", "))


@tables.tidy
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    model = quality_classifier.fit(*quality_classifier.sample(docs, tables.read(spark, sf_dir, "labels")))
    typed = docs.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")])
    return quality_classifier.scored(typed, model, SCHEMA).filter(F.col("score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


@tables.tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the first by doc_id, then by a hash of its text.  Documents without words stay."""
    found = ngram_join.similar(docs.select("doc_id", "text"), shingle=5, percent=80)
    first = found.filter("n_shingles > 0").groupBy("class").agg(F.min(F.struct("_key", "text_hash")).alias("first")).select("first.*")
    kept = first.withColumn("worded", F.lit(True)).unionByName(found.filter("n_shingles = 0").select("_key", "text_hash").distinct().withColumn("worded", F.lit(False)))
    tagged = docs.select(*COLUMNS, tables.doc_key().alias("_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = tagged.join(kept, ["_key", "text_hash"])
    order = Window.partitionBy("_key", "text_hash").orderBy("lang", "source", "n_chars")
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1 or not worded").select(*COLUMNS)


@tables.tidy
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontamination.marked(docs, tables.read(spark, sf_dir, "benchmark"), SCHEMA).filter("n_hit = 0").select(*COLUMNS)


@tables.tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs.select(*COLUMNS)).select(*COLUMNS)


@tables.tidy
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the token files."""
    return token_output.encoded_documents(docs.select("doc_id", "text"), token_output.public_tokenizer(), special=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]


@tables.tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.written(docs)
            if i:
                tables.forget(spark, before)
    return docs


#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None
