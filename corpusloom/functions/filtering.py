"""Document filters: each is a boolean Column; the chain names the first that fails."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import batched
from .cleaning import strip

# Limits and patterns of the filters.
HEX_RUN = "\\b[0-9a-fA-F]{20,}\\b"
BIT_RUN = "\\b[01]{20,}\\b"
SYMBOL = "[\\p{S}\\p{P}]"
SENTENCE = "\\p{Lu}[^.!?]*[.!?]"
# End of fixed values.


@dataclass(frozen=True)
class Limits:
    min_chars: int = 200
    max_chars: int = 1_000_000
    min_words: int = 30
    min_sentences: int = 3
    min_entropy: float = 3.0
    max_symbol_ratio: float = 0.3
    min_compression: float | None = 1.1
    garbage: bool = True
    stopwords: tuple[str, ...] = ()
    min_stopwords: float = 0.01
    max_stopwords: float = 0.8


#: White space as Python's str.split sees it, within brackets.
_GAP = "\\s\\x1c-\\x1f"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U)[^{_GAP}]+"), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U)[^{_GAP}]+"))


def length_ok(text: Column, low: int = 100, high: int = 1_000_000) -> Column:
    return F.length(strip(text)).between(low, high)


def _bits(text: str | None) -> float | None:
    if not text:
        return None if text is None else 0.0
    if text.isascii():
        counts = np.bincount(np.frombuffer(text.encode(), np.uint8))
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.bincount(points) if points.max() < 1 << 16 else np.unique(points, return_counts=True)[1]
    counts = counts[counts > 1]
    n = len(text)
    return math.log2(n) - float(counts @ np.log2(counts)) / n


@batched("double")
def entropy(text: pd.Series) -> pd.Series:
    """Bits a character; 0 for an empty text.  Counting characters by SQL functions sorts or rebuilds each text."""
    return pd.Series([_bits(t) for t in text], dtype="float64")


def sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE))


def n_solid(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(text) - F.regexp_count(text, F.lit(f"(?U)[{_GAP}]"))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL))


def symbol_share(text: Column) -> Column:
    """Symbols and punctuation among characters that are no white space; null without any."""
    solid = n_solid(text)
    return F.when(solid > 0, n_symbols(text) / solid)


def garbage(text: Column) -> Column:
    return text.rlike(HEX_RUN) | text.rlike(BIT_RUN)


def stopword_share(text: Column, stopwords) -> Column:
    every = words(text)
    known = F.array(*[F.lit(w) for w in sorted(set(stopwords))])
    return F.when(F.size(every) > 0, F.size(F.filter(every, lambda w: F.array_contains(known, F.lower(w)))) / F.size(every))


@batched("double")
def bytes_over_compressed(text: pd.Series) -> pd.Series:
    """UTF-8 bytes over zlib bytes, for what Spark has no function."""
    raw = [None if t is None else t.encode() for t in text]
    return pd.Series([None if b is None else len(b) / len(zlib.compress(b)) for b in raw], dtype="float64")


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns that are computed once: a filter on them is not pushed below, to compute them again."""
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.drop(*columns).withColumn("_settled", packed).select(*[c for c in rows.columns if c not in columns], "_settled.*")


#: A filter of the chain: a name, and from the stripped text, its measures and the limits to whether a text fails.
FILTERS: list[tuple[str, Callable[[Column, dict[str, Column], Limits], Column | None]]] = [
    ("length", lambda t, m, x: ~F.length(t).between(max(1, x.min_chars), x.max_chars)),
    ("word_count", lambda t, m, x: n_words(t) < x.min_words),
    ("sentence_count", lambda t, m, x: sentences(t) < x.min_sentences),
    ("entropy", lambda t, m, x: m["entropy"] < x.min_entropy),
    ("symbol_ratio", lambda t, m, x: F.coalesce(symbol_share(t), F.lit(9.0)) > x.max_symbol_ratio),
    ("compression", lambda t, m, x: None if x.min_compression is None else m["compression"] < x.min_compression),
    ("garbage", lambda t, m, x: garbage(t) if x.garbage else None),
    ("stopword_ratio", lambda t, m, x: ~F.coalesce(stopword_share(t, x.stopwords), F.lit(-1.0)).between(x.min_stopwords, x.max_stopwords) if x.stopwords else None),
]


def _first_failing(t: Column, measures: dict[str, Column], limits: Limits, filters=None) -> Column:
    out = F.lit(None).cast("string")
    for name, fails in reversed(FILTERS if filters is None else filters):
        found = fails(t, measures, limits)
        if found is not None:
            out = F.when(found, F.lit(name)).otherwise(out)
    return out


def reject_reason(text: Column, limits: Limits = Limits(), filters=None) -> Column:
    """The first filter that fails, or null, as a Column.  Null and blank texts fail by length.

    Each filter strips the text again; ``with_reason`` does so once."""
    t = strip(F.coalesce(text, F.lit("")))
    return _first_failing(t, {"entropy": entropy(t), "compression": bytes_over_compressed(t)}, limits, filters)


def with_reason(rows: DataFrame, text: str = "text", limits: Limits = Limits(), into: str = "reason", filters=None) -> DataFrame:
    """Rows with the first filter that fails, or null.  Null and blank texts fail by length.

    The text is stripped once and measured once, in columns of their own."""
    measured = settled(rows, _t=strip(F.coalesce(text, F.lit("")))).withColumn("_entropy", entropy("_t"))
    measures = {"entropy": F.col("_entropy")}
    if limits.min_compression is not None:
        measured = measured.withColumn("_packed", bytes_over_compressed("_t"))
        measures["compression"] = F.col("_packed")
    return settled(measured, **{into: _first_failing(F.col("_t"), measures, limits, filters)}).drop("_t", "_entropy", "_packed")
