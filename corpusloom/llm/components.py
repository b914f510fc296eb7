"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables as T

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of an edge (a, b).

    Each round's edges are written to the shared folder; neither a component nor
    the neighbours of a node are gathered in one place."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = T.written(edges.filter("a <> b").select(high.alias("u"), low.alias("v")).distinct())
    seen = _state(now)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        then = T.written(_small_star(_large_star(now)))
        T.forget(now.sparkSession, now)
        now, before, seen = then, seen, _state(then)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
