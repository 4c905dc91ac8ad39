"""Alert states and rings of the newest values, kept as the state of a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import FIRING, INACTIVE, PENDING

STATES = "alert string, at bigint, value double, state string, since bigint"
RINGS = "queue string, n bigint, mean double, p50 double, p95 double, p95_nearest double"


class Held(StatefulProcessor):
    """One alert: since when evaluations are over the limit, and when the last one was."""

    def __init__(self, step_s: int):
        self.step_s = step_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "since bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, last = self.run.get() if self.run.exists() else (None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            over = bool(r.over) if r.over is not None and r.over == r.over else False
            if not over:
                since = None
            elif since is None or r.at - last != self.step_s:  # an evaluation between is missing
                since = r.at
            last = r.at
            state = INACTIVE if since is None else FIRING if r.at - since >= r.hold_s else PENDING
            out.append((key[0], r.at, r.value, state, since))
        if since is None:
            self.run.clear()
        else:
            self.run.update((since, last))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])
        yield frame.astype({"since": "Int64"})

    def close(self) -> None:
        pass


def held(evaluations: DataFrame, step_s: int) -> DataFrame:
    """STATES of a stream of (alert, at, value, over, hold_s), evaluations of an alert in the order of ``at``: what ``operators.alerts.states`` gives for a table.

    ``at`` counts seconds, ``step_s`` apart. An alert's state is two numbers, and none while it is inactive. RocksDB must hold the state.
    """
    return evaluations.groupBy("alert").transformWithStateInPandas(Held(step_s), STATES, "Append", "None")


class Ring(StatefulProcessor):
    """One queue's newest values, ordered by time and number."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "ts bigint, id bigint, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.values.get()) if self.values.exists() else []
        for part in rows:  # a batch of any size: never more than the ring and one part of it
            new = zip(part["ts"].tolist(), part["id"].tolist(), part["value"].tolist(), strict=True)
            kept = sorted([*kept, *(x for x in new if x[2] is not None and not math.isnan(x[2]))], key=lambda x: x[:2])[-self.size :]
        if not kept:
            return
        self.values.put([tuple(x) for x in kept])
        v = np.sort([x[2] for x in kept])
        at = max(math.ceil(0.95 * len(v)) - 1, 0)
        yield pd.DataFrame([(key[0], len(v), float(np.mean(v)), float(np.quantile(v, 0.5)), float(np.quantile(v, 0.95)), float(v[at]))], columns=[c.split()[0] for c in RINGS.split(", ")])

    def close(self) -> None:
        pass


def rings(values: DataFrame, size: int = 512) -> DataFrame:
    """RINGS of the newest ``size`` values of each queue, at every update, from a stream of (queue, ts: microseconds, id, value).

    Newest by time, then by number, whatever order rows come in; null values are left out. Write it in update mode. RocksDB must hold the state,
    which is ``size`` rows for each queue.
    """
    return values.groupBy("queue").transformWithStateInPandas(Ring(size), RINGS, "Update", "None")
