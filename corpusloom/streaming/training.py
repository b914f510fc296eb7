"""Stateful training signals: loss spikes against a rolling mean of the losses that were kept."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Window, multiple of the mean, losses needed before a spike counts.
WINDOW, MULTIPLE, LEAST = 50, 5.0, 10
# End of fixed values.


class Detector:
    """Losses that are no number or far above the mean of the last kept ones; those are not kept themselves."""

    def __init__(self, kept=()):
        self.kept = deque(kept, maxlen=WINDOW)

    def feed(self, loss: float | None) -> str | None:
        if loss is None or math.isnan(loss) or math.isinf(loss):
            return "nan_or_inf"
        if len(self.kept) >= LEAST:
            mean = sum(self.kept) / len(self.kept)
            if mean > 0 and loss > MULTIPLE * mean:
                return "loss_spike"
        self.kept.append(loss)
        return None


def spikes(log: DataFrame, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """run, step, loss, reason over a whole log; each run is folded in order of step.

    Runs are folded from sorted batches, so memory follows the batch and not the run."""
    kinds = dict(log.dtypes)
    ordered = log.selectExpr(f"`{run}` as run", f"`{step}` as step", f"cast(`{loss}` as double) as loss").repartition("run").sortWithinPartitions("run", "step", "loss")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, d = object(), Detector()
        for x in batches:
            reasons = []
            for name, value in zip(x["run"].tolist(), x["loss"].tolist(), strict=True):
                if name != now:
                    now, d = name, Detector()
                reasons.append(d.feed(value))
            yield x.assign(reason=reasons).dropna(subset=["reason"])[["run", "step", "loss", "reason"]]

    return ordered.mapInPandas(fold, f"run {kinds[run]}, step {kinds[step]}, loss double, reason string")


def spike_stream(log: DataFrame) -> DataFrame:
    """The same over a stream (run string, step long, loss double): the kept losses are the state of a run."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Detector(state.get[0] if state.exists else ())
        for pdf in parts:
            pdf = pdf.sort_values("step", kind="stable")
            yield pdf.assign(reason=[d.feed(x) for x in pdf["loss"]]).dropna(subset=["reason"])[["run", "step", "loss", "reason"]]
        state.update((list(d.kept),))

    return log.groupBy("run").applyInPandasWithState(fold, "run string, step long, loss double, reason string", "kept array<double>", "append", GroupStateTimeout.NoTimeout)
