"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees of depth three are grown on a bounded sample of labelled
documents.  Each path from a root is a rule, a conjunction of thresholds.  A
logistic model with an L1 penalty weighs the rules, most with zero, and the
rest compile into one Spark column over the statistics.

Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2, at
most ``MOST_ROWS`` of them, those of the least md5(doc_id).  Language, source
and doc_id are never inputs.

Cases: null and empty texts are scored by their (zero) statistics; a null
doc_id is scored, is not held out and never learnt from; a document labelled
more than once counts with each label, and once for equal labels; of several
texts of a labelled doc_id one is learnt from; null labels are left out; with labels
of one class or none, or too few to split, every score is that share, or 0.5; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T
from .text_stats import NAMES, text_stats

MOST_ROWS, TREES, DEPTH, BINS, PENALTY, THRESHOLD = 20_000, 40, 3, 48, 5e-4, 0.7


@dataclass(frozen=True)
class Rule:
    """All of (statistic, below, limit): value <= limit where below, else value > limit."""

    parts: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, below, limit in self.parts:
            v = x[:, NAMES.index(name)]
            out &= (v <= limit) if below else (v > limit)
        return out

    def column(self) -> Column:
        out = None
        for name, below, limit in self.parts:
            one = F.col(name) <= F.lit(limit) if below else F.col(name) > F.lit(limit)
            out = one if out is None else out & one
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[float, Rule], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for w, r in self.rules:
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z = F.lit(self.bias)
        for w, r in self.rules:
            z = z + F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grow(binned, cuts, grad, hess, rows, depth, path, rules, leaf):
    """Grow one tree; adds the rule of each node and the value of each row's leaf."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 8) | (len(rows) - nl < 8)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    _, j, k = best
    if j is None:
        leaf[rows] = -g / (h + 1)
        return
    left = binned[rows, j] <= k
    for below, part in ((True, rows[left]), (False, rows[~left])):
        then = (*path, (NAMES[j], below, float(cuts[j][k])))
        rules.append(Rule(tuple(sorted(then))))
        _grow(binned, cuts, grad, hess, part, depth - 1, then, rules, leaf)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal steps."""
    mean, n = x.mean(0), len(y)
    scale = np.maximum(x.std(0), 0.05)
    z = (x - mean) / scale
    v = np.ones(z.shape[1]) / max(1, z.shape[1]) ** 0.5
    for _ in range(30):
        v = z.T @ (z @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1) + 1e-9)
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ pw + pb, -30, 30)))
        nw = pw - rate * (z.T @ (p - y) / n)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = pb - rate * float((p - y).mean())
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pw, pb = nw + (t - 1) / s * (nw - w), nb + (t - 1) / s * (nb - b)
        w, b, t = nw, nb, s
    w = w / scale
    return b - float(mean @ w), w


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Model:
    """x: rows of statistics in the order of NAMES; y: 0 or 1."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    score, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        leaf = np.zeros(len(y))
        _grow(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, (), rules, leaf)
        score = score + 0.3 * leaf
    rules = sorted(set(rules), key=lambda r: r.parts)
    if not rules:  # too few labels to tell them apart
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    bias, w = _lasso(np.stack([r.holds(x) for r in rules], 1).astype(float), y.astype(float), penalty)
    return Model(bias, tuple((float(a), r) for a, r in zip(w, rules, strict=True) if abs(a) > 1e-9))


def sample(documents: DataFrame, labels: DataFrame, most: int = MOST_ROWS, learn: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled documents."""
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    chosen = of.filter(~held_out(F.col("doc_id"))).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "quality").limit(most)
    chosen = F.broadcast(T.written(chosen))  # as many rows as ``most`` allows
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    # of several texts of a doc_id the one of the least hash: a row for each label at most
    docs = docs.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = text_stats(docs, "doc_id long, quality int").toPandas().sort_values(["doc_id", "quality", *NAMES])
    return rows[list(NAMES)].to_numpy(float), rows["quality"].to_numpy(float)


def scored(documents: DataFrame, model: Model, keep: str = "doc_id long") -> DataFrame:
    """The kept columns, the statistics and score."""
    return text_stats(documents, keep).withColumn("score", model.column())


@T.tidy
def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents = T.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(*sample(documents, T.read(spark, sf_dir, "labels")))
    return scored(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
