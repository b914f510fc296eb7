"""Writers: sharded documents, dialogue files, reports.  Spark's commit protocol makes a write whole or absent."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for all executors and the driver; only a session on one machine may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        where = f"/tmp/checkpoints/{os.getpid()}"
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can write and read."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def sharded(docs: DataFrame, path: str, rows: int = 10_000, form: str = "json", mode: str = "errorifexists") -> None:
    docs.write.mode(mode).option("maxRecordsPerFile", rows).format(form).save(path)


def pinned(docs: DataFrame, path: str, **names: str) -> None:
    """Append documents to a dataset that keeps the names it was made with; other names raise."""
    spark = docs.sparkSession
    meta = f"{path}/_meta"
    try:
        have = spark.read.json(meta).first().asDict()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
        spark.createDataFrame([tuple(names.values())], list(names)).coalesce(1).write.json(meta)
    if have is not None and have != names:
        raise RuntimeError(f"made with {have}, asked for {names}")
    docs.write.mode("append").parquet(f"{path}/data")


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def flattened(results_: DataFrame, metrics: list[str]) -> DataFrame:
    """A boolean column for each metric of an array of results."""
    pick = lambda m: F.get(F.filter("metrics", lambda x: x["metric"] == m), F.lit(0))["passed"].alias(m)
    return results_.select("*", *[pick(m) for m in metrics]).drop("metrics")


def generation_report(rows: DataFrame, rejections: DataFrame, target: int, existing: int) -> DataFrame:
    """One row: target, existing, generated, complete, rows by message count, rejections by reason."""
    depth = rows.groupBy(F.size("messages").alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("rows_by_message_count"))
    why = rejections.filter(~F.contains("reason", F.lit(":"))).groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejections"))
    n = rows.agg(F.count("*").alias("final_rows"))
    out = n.crossJoin(depth).crossJoin(why)  # single rows
    return out.select(F.lit(target).alias("target"), F.lit(existing).alias("existing"), (F.col("final_rows") - existing).alias("generated"), (F.col("final_rows") >= target).alias("complete"), "rows_by_message_count", "rejections")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def reset(spark: SparkSession, *paths: str) -> None:
    """Remove results and summaries of an earlier run; what is not there is no error."""
    for path in paths:
        _remove(spark, path)


def summary(rows: DataFrame, path: str) -> None:
    """A summary takes the place of the one before."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def vocab(tokens: DataFrame, path: str) -> None:
    """A token a line, in order of token_id; within a token, back slashes and line ends are escaped."""
    spelled = F.col("token")
    for plain, coded in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        spelled = F.replace(spelled, F.lit(plain), F.lit(coded))
    tokens.select("token_id", spelled.alias("value")).coalesce(1).sortWithinPartitions("token_id").select("value").write.mode("overwrite").text(path)  # a vocabulary


def records(rows: DataFrame, path: str, kind: str) -> None:
    """Append typed records to a log of JSON lines: type, and the columns of the rows."""
    rows.select(F.lit(kind).alias("type"), "*").write.mode("append").json(path)


def tagged(rows: DataFrame, text, path: str, review: str) -> None:
    """Rows whose instruction tells a constraint, with it, to one place; the others, as they are, to another."""
    from ..functions.answers import NEEDS_VALUE, infer_constraint

    found = rows.withColumn("_c", infer_constraint(text))
    sure = F.col("_c").isNotNull() & (~F.col("_c.constraint_type").isin(*NEEDS_VALUE) | F.col("_c.constraint_value").isNotNull())
    sure = F.coalesce(sure, F.lit(False))
    found.filter(sure).select(*rows.columns, "_c.constraint_type", "_c.constraint_value").write.mode("overwrite").json(path)
    found.filter(~sure).select(*rows.columns).write.mode("overwrite").json(review)
