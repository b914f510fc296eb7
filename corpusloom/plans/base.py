"""Registration of queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import ship, spread

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is there already")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def duck_replace(column: str, steps) -> str:
    """The same replacements in DuckDB's dialect."""
    import re

    for pattern, by in steps:
        by = re.sub(r"\$(\d)", r"\\\1", by)
        column = f"regexp_replace({column}, {literal(pattern)}, {literal(by)}, 'g')"
    return column
