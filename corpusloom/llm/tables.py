"""Reading the inputs, cutting lineage, and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship, spread
from ..sources.writers import shared_folder

#: Stands for a null doc_id: such rows come after all others.
LAST_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def doc_key(column: str = "doc_id") -> Column:
    """doc_id as a long that orders null last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


#: Removes the shuffle files of a query when it ends; the tables that it wrote hold its rows.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[list[str]] = []


def folder(spark: SparkSession, kind: str = "table") -> str:
    """The name of a new folder that all executors and the driver see."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it: later jobs start from its files."""
    spark = df.sparkSession
    ship(spark)
    path = folder(spark)
    if _open:
        _open[-1].append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _roots(df: DataFrame) -> set[str]:
    """The folders that a table's plan reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            paths = leaf.relation().location().rootPaths()
            out |= {paths.apply(k).toUri().getPath() for k in range(paths.size())}
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for path in {p for table in tables for p in _roots(table) if f"/{spark.sparkContext.applicationId}/" in p}:
        for own in _open:
            own[:] = [x for x in own if not x.endswith(path)]
        _delete(spark, path)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Within it, tables are written that go at its end, but for those that a table given to ``keep`` reads."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept.append
    finally:
        mine = _open.pop()
        needed = set().union(*[_roots(x) for x in kept]) if kept else set()
        for path in mine:
            if any(path.endswith(x) or x.startswith(path) for x in needed):
                if _open:
                    _open[-1].append(path)  # whoever asked for the result lets go of it
            else:
                _delete(spark, path)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that leaves no written table behind but those that its result reads."""

    @wraps(f)
    def run(*args, **options) -> DataFrame:
        spark = next(x if isinstance(x, SparkSession) else x.sparkSession for x in args if isinstance(x, (SparkSession, DataFrame)))
        with scope(spark) as keep:
            out = f(*args, **options)
            keep(out)
        return out

    return run


#: Frequent keys that travel with the tasks: at most so many, each with at least so many rows.
HOT, LEAST_HOT = 1_000, 1_000


def hot_joined(rows: DataFrame, table: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join rows with a table of one row for each key, so that no frequent key gathers in a task.

    table: the keys, ``count`` (how many rows have the key) and further columns.  The rows of its most frequent keys meet
    them by broadcast, of ``HOT`` keys at most; all others meet by a merge."""
    hot = written(table.filter(F.col(count) >= LEAST_HOT).orderBy(F.col(count).desc(), *on).limit(HOT))
    names = F.broadcast(hot.select(*on))
    few = rows.join(F.broadcast(hot), on)
    rest = rows.join(names, on, "left_anti").join(table.join(names, on, "left_anti").hint("merge"), on, how)
    return few.unionByName(rest)


_held: dict = {}
_give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _stage() -> int | None:
    context = TaskContext.get()
    return context and context.stageId()


def held(make: Callable, *args):
    """make(*args), shared by the tasks of a stage in a worker; it goes when a task of another stage begins there."""
    key = (_stage(), make, args)
    if key not in _held:
        _held[key] = make(*args)
    return _held[key]


def let_go() -> None:
    """Drop what earlier stages hold."""
    for key in [k for k in _held if k[0] != _stage()]:
        del _held[key]


def light(run: Callable) -> Callable:
    """A function over a task's batches that drops what earlier stages hold, and gives memory back at its end, as workers live on."""

    def whole(batches):
        let_go()
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _give_back:
        _give_back(0)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str, **columns) -> DataFrame:
    """mapInArrow with a function from a batch to one or more dicts of columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            found = f(batch)
            for part in [found] if isinstance(found, dict) else found:
                arrays = [as_arrow(part[x.name], x.type) for x in target]
                whole = pa.RecordBatch.from_arrays(arrays, schema=target)
                for at in range(0, whole.num_rows, 1 << 16):
                    yield whole.slice(at, 1 << 16)

    return df.mapInArrow(light(run), schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, kind)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column from all items and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def list_items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Items of a list column and the row of each; null lists are empty."""
    counts = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), counts)
