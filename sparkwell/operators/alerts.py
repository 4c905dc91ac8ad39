"""Rates and quantiles over sliding ranges, and alerts that must hold before they fire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

INACTIVE, PENDING, FIRING = "inactive", "pending", "firing"


def bucket_counts(value: Column, bounds: Sequence[float]) -> Column:
    """An aggregate: how many values are at most each bound, then how many there are. Bounds ascend; null values are in no bucket."""
    return F.array(*[F.count_if(value <= b) for b in bounds], F.count(value))


def histogram_quantile(q: float, bounds: Sequence[float], counts: Column) -> Column:
    """The q-quantile from cumulative ``counts``, linear within its bucket.

    The first bucket begins at 0, or is its bound if that is not above 0; beyond the last bound the answer is that bound; no values give null.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be from 0 to 1")
    if list(bounds) != sorted(set(bounds)) or not bounds:
        raise ValueError("bounds must ascend")
    ends = F.array(*[F.lit(float(b)) for b in bounds])

    def of(c: Column) -> Column:
        rank = F.element_at(c, -1) * q
        i = F.size(F.filter(c, lambda x: x < rank))
        start = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.least(F.get(ends, F.lit(0)), F.lit(0.0)))
        before = F.when(i > 0, F.get(c, i - 1)).otherwise(F.lit(0))
        inside = F.get(c, i) - before
        within = start + (F.get(ends, i) - start) * F.when(inside > 0, (rank - before) / inside).otherwise(F.lit(0.0))
        return F.when(F.element_at(c, -1) > 0, F.when(i >= len(bounds), F.lit(float(bounds[-1]))).when((i == 0) & (F.get(ends, F.lit(0)) <= 0), F.get(ends, F.lit(0))).otherwise(within))

    return let(counts, of)


def ranges(rows: DataFrame, ts: str, by: list[str], length: str, step: str, **values: Column) -> DataFrame:
    """(by, at, values): aggregates over the range of ``length`` before each evaluation, one every ``step``; ``at`` is its end in seconds.

    A row is in length / step ranges, which are summed where the rows are before anything is shuffled. Ranges without rows are not there.
    """
    w = F.window(ts, length, step)
    return rows.groupBy(*by, w.alias("_w")).agg(*[v.alias(k) for k, v in values.items()]).withColumn("at", F.unix_timestamp("_w.end")).drop("_w")


def states(values: DataFrame, by: list[str], over: Column, hold_s: Column | int, step_s: int, at: str = "at") -> DataFrame:
    """``values`` with ``state`` and ``since``: an alert is pending from the first of consecutive evaluations over its limit, and fires once they span ``hold_s``.

    An evaluation that is missing, or null, ends the run like one below the limit. The rows of one key are its evaluations, not the events
    behind them. ``since`` is null while it is inactive.
    """
    hold = hold_s if isinstance(hold_s, Column) else F.lit(hold_s)
    rows = values.withColumn("_over", F.coalesce(over, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*by, "_over").orderBy(at))
    rows = rows.withColumn("_run", F.col(at) - place * step_s)  # equal along a run without gaps
    since = F.when(F.col("_over"), F.min(at).over(Window.partitionBy(*by, "_over", "_run")))
    rows = rows.withColumn("since", since)
    state = F.when(~F.col("_over"), INACTIVE).when(F.col(at) - F.col("since") >= hold, FIRING).otherwise(PENDING)
    return rows.withColumn("state", state).drop("_over", "_run")
