"""Arrow UDFs over batches, made when they are used, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def batched(kind: str) -> Callable:
    """Turn a function from Series to Series (or DataFrame) into one from Columns to a Column."""

    def wrap(f: Callable) -> Callable[..., Column]:
        return lambda *columns: pandas_udf(f, kind)(*columns)

    return wrap
