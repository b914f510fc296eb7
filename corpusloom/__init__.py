"""Corpus and conversation analytics planned as Spark DataFrames."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors' Python workers, once for each application, so that they can import it."""
    context, here = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not here.is_dir():
        return
    _shipped.add(context.applicationId)
    path = f"{tempfile.mkdtemp(prefix='corpusloom-')}/corpusloom_source.zip"
    with zipfile.ZipFile(path, "w") as z:
        for x in sorted(here.rglob("*.py")):
            z.write(x, f"{here.name}/{x.relative_to(here)}")
    context.addPyFile(path)


#: File tables of fewer bytes are left in the splits they come in.
_LEAST_BYTES = 4_000_000


def spread(df):
    """A file table of fewer splits than there are cores, dealt to all cores; any other table as it is.

    Only a table of few files, and so of bounded size, is ever dealt."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not _LEAST_BYTES <= size <= cores * (128 << 20) or len(df.inputFiles()) > cores // 2:
        return df
    return df.repartition(cores)
