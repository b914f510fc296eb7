"""Orders over whole tables in two steps: ranges of a key, then the rows of a range, so that no window holds a table."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A range has about so many rows; a table has at most so many ranges.
ROWS, MOST = 50_000, 20_000
_SPLITS = 1 << 20


def _below(bounds: Column, n: int, key: Column) -> Column:
    """How many of n sorted bounds lie below a key, by halving."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        less = F.get(bounds, mid) < key
        done = s["low"] >= s["high"]
        return F.struct(F.when(done | ~less, s["low"]).otherwise(mid + 1).alias("low"), F.when(done | less, s["high"]).otherwise(mid).alias("high"))

    zero = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length() + 1))), zero, step, lambda s: s["low"])


def _longs(values) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def ranged(rows: DataFrame, key: str, tie: Column, weight: Column | None = None, each: int = ROWS, most: int = MOST) -> DataFrame:
    """_range: a number that ascends with key, a long without nulls.

    Ranges have about ``each`` rows (or so much weight, if rows weigh alike).  A key that would fill several is cut by
    ``tie``, a long hash of the row: the order of all rows is key, then tie."""
    size = rows.agg((F.count("*") if weight is None else F.sum(weight)).alias("n")).first()["n"] or 0
    parts = int(max(1, min(most, -(-size // each))))
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts + 1000)).first()[0] if parts > 1 else None
    if not cuts:
        return rows.withColumn("_range", F.lit(0).cast("long"))
    times = Counter(cuts)
    bounds = sorted(times)
    at = _below(_longs(bounds), len(bounds), F.col(key))
    own = F.coalesce(F.get(_longs(bounds), F.col("_at")) == F.col(key), F.lit(False))
    pieces = F.get(_longs([times[b] for b in bounds]), F.col("_at"))
    sub = F.when(own & (pieces > 1), F.floor((F.shiftright(tie, 32) + (1 << 31)) * pieces / (1 << 32)) + 1).otherwise(F.lit(0))
    return rows.withColumn("_at", at).withColumn("_range", F.col("_at").cast("long") * _SPLITS + sub).drop("_at")


def running(rows: DataFrame, size: Column, order: list, by: tuple[str, ...] = (), into: str = "start") -> DataFrame:
    """The sum of the sizes before each row, in order, among the rows that agree in ``by``. rows: with _range, which it loses."""
    kept = [c for c in rows.columns if c != "_range"]
    sized = rows.withColumn("_size", size.cast("long"))
    sums = sized.groupBy(*by, "_range").agg(F.sum("_size").alias("_sum"))
    before = sums.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_range").alias("_r"), (F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_sum")).alias("_before"))
    part = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("_local", F.sum("_size").over(part) - F.col("_size"))
    on = F.col("_range") == F.col("_r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return placed.join(before, on).select(*kept, (F.col("_before") + F.col("_local")).alias(into))


def numbered(rows: DataFrame, order: list, by: tuple[str, ...] = (), into: str = "place") -> DataFrame:
    """The number of each row, from 1, in order, among the rows that agree in ``by``."""
    return running(rows, F.lit(1), order, by, into).withColumn(into, F.col(into) + 1)


def hashed(rows: DataFrame, name: str, order: Column, each: int = ROWS, most: int = MOST) -> DataFrame:
    """_range of an order that is a hexadecimal hash, column ``name``: ranges of equal width."""
    rows = rows.withColumn(name, order)
    n = rows.count()
    parts = max(1, min(most, -(-n // each)))
    return rows.withColumn("_range", F.floor(F.conv(F.substring(name, 1, 8), 16, 10).cast("long") * parts / (1 << 32)).cast("long"))
