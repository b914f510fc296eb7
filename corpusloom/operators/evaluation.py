"""Benchmark evaluation: context, metrics by category, gates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A

# Completion thresholds by category, the floor, and how many checkpoints in a row.
THRESHOLDS = {"turn_taking": 0.95, "knowledge_completion": 0.90, "local_context": 0.80, "correction": 0.75, "instruction_following": 0.80, "uncertainty": 0.75}
FLOOR, IN_A_ROW = 0.60, 2
# End of fixed values.


def merged_list(shared: Column, own: Column) -> Column:
    """The category's list, then the row's, each value once."""
    return F.array_distinct(F.concat(F.coalesce(shared, F.expr("cast(array() as array<string>)")), F.coalesce(own, F.expr("cast(array() as array<string>)"))))


def own_or_shared(own: Column, shared: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), shared)


def evaluated(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, category, language, metrics (array of metric, role, passed), failed_checks, passed.

    rows: id, category, language, answer, expected_any, expected_token, constraint_type, constraint_value, and for
    coherence unknown and unknown_elsewhere. manifest: category, metric, role, expected_any.  Metrics are those of
    ``answers.METRICS``; an unknown one raises, and one whose input is missing has no result."""
    columns = set(rows.columns)
    for name, kind in (("expected_any", "array<string>"), ("unknown", "array<string>"), ("unknown_elsewhere", "array<string>"), ("expected_token", "string"), ("constraint_type", "string"), ("constraint_value", "string")):
        if name not in columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    joined = rows.join(manifest.select("category", "metric", "role", F.col("expected_any").alias("shared")), "category")
    joined = joined.withColumn("expected", merged_list(F.col("shared"), F.col("expected_any")))
    asked = {r["metric"] for r in manifest.select("metric").distinct().collect()}  # a manifest is written by hand
    if asked - set(A.METRICS):
        raise ValueError(f"unknown metric: {sorted(asked - set(A.METRICS))}")
    passed = F.lit(None).cast("boolean")
    for name in sorted(asked):
        metric, needs = A.METRICS[name]
        there = F.lit(True)
        for c in needs:
            there = there & (F.size(c) > 0 if c == "expected" else F.col(c).isNotNull())
        found = metric(F.col("answer"), *[F.col(c) for c in (*needs, *A.OPTIONAL.get(name, ()))])["passed"]
        passed = F.when((F.col("metric") == name) & there, found).otherwise(passed)
    per = joined.select("id", "category", "language", "metric", "role", passed.alias("ok"))
    found = F.array_sort(F.collect_list(F.struct("metric", "role", F.col("ok").alias("passed"))))
    out = per.groupBy("id", "category", "language").agg(found.alias("metrics"))
    failed = F.transform(F.filter("metrics", lambda m: (m["role"] == "gate") & ~F.coalesce(m["passed"], F.lit(False))), lambda m: m["metric"])
    return out.withColumn("failed_checks", failed).withColumn("passed", F.size("failed_checks") == 0)


def summary(results: DataFrame) -> DataFrame:
    """Totals and pass rates overall and by category and language."""
    n = F.count_if("passed")
    sets = results.groupingSets([[], ["category", "language"]], "category", "language")
    return sets.agg(F.count("*").alias("total"), n.alias("passed"), F.bround(n / F.count("*"), 4).alias("pass_rate"))


def metric_counts(results: DataFrame) -> DataFrame:
    """How many rows ran and passed each metric, by category and language."""
    per = results.select("category", "language", F.explode("metrics").alias("m"))
    return per.groupBy("category", "language", F.col("m.metric").alias("metric")).agg(F.count("*").alias("ran"), F.count_if(F.col("m.passed")).alias("passed"))


def deltas(summaries: DataFrame) -> DataFrame:
    """Change of pass_rate against the step before. summaries: step, category, pass_rate."""
    before = F.lag("pass_rate").over(Window.partitionBy("category").orderBy("step"))
    return summaries.withColumn("delta", F.round(F.col("pass_rate") - before, 6)).withColumn("new", before.isNull())


def stable(summaries: DataFrame) -> DataFrame:
    """Whether a category holds its threshold at this step and the one before, and every category the floor at this step."""
    listed = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])
    s = summaries.withColumn("ok", F.col("pass_rate") >= F.try_element_at(listed, F.col("category")))
    w = Window.partitionBy("category").orderBy("step")
    floor = F.min("pass_rate").over(Window.partitionBy("step")) >= FLOOR
    return s.withColumn("stable", F.col("ok") & F.coalesce(F.lag("ok").over(w), F.lit(False))).withColumn("above_floor", floor)


def weakest(summaries: DataFrame, categories: tuple[str, str]) -> DataFrame:
    """The lower pass rate of two categories at each step."""
    a, b = categories
    p = summaries.groupBy("step").pivot("category", [a, b]).agg(F.first("pass_rate"))
    return p.select("step", F.least(a, b).alias("score"))


def turn_structure(results: DataFrame) -> DataFrame:
    """One less the share of rows where the stop token or the loop check fails."""
    bad = F.exists("metrics", lambda m: m["metric"].isin("expected_stop_token", "repetition") & ~F.coalesce(m["passed"], F.lit(False)))
    return results.groupBy("category").agg((1 - F.avg(bad.cast("double"))).alias("score"))
