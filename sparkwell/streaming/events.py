"""Windows, sessions, deduplication, rate limits, caches and dead letters over a stream of events.

Every function takes and gives a streaming or a batch DataFrame; state is bounded by watermarks or timers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream; the checkpoint is the consumer's acknowledgement."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def rates(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and failures in tumbling or sliding windows; later rows than ``late`` are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "failures")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: rows less than ``gap`` apart."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), "n")


def once(events: DataFrame, key: str = "event_id", within: str = "24 hours") -> DataFrame:
    """Rows whose key was not seen within that time; each key is forgotten on its own."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def limited(events: DataFrame, most: int = 3, window_ms: int = 86_400_000, late: str = "1 day") -> DataFrame:
    """(event_id, allowed): windows open with a user's first event, last ``window_ms`` and let ``most`` events pass.

    The state of a user is two numbers; it goes when the window is over. Rows later than ``late`` are dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for ts in rows["ts"]:
            ms = int(ts.timestamp() * 1000)
            if anchor is None or ms - anchor >= window_ms:
                anchor, n = ms, 0
            n += 1
            allowed.append(n <= most)
        state.update((anchor, n))
        state.setTimeoutTimestamp(max(int(anchor + window_ms), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"event_id": rows["event_id"], "allowed": allowed})

    stream = events.withWatermark("ts", late).groupBy("user_id")
    return stream.applyInPandasWithState(run, "event_id bigint, allowed boolean", "anchor bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def with_profile(events: DataFrame, profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """Stream-static join: each event with what a table knows of its user."""
    return events.join(profiles, key, "left")


def split_dead(sink: Callable[[DataFrame, str], None], most_attempts: int = 5) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: jobs (with a column ``attempts``) that are used up go to ``dead``, failed ones to ``retry``, others to ``done``."""

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        failed = F.col("event_type") == "error"
        delay = (1000 * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("bigint")
        sink(batch.where(failed & (F.col("attempts") >= most_attempts)).withColumn("failed_at", F.col("ts")), "dead")
        sink(batch.where(failed & (F.col("attempts") < most_attempts)).withColumn("delay_ms", delay), "retry")
        sink(batch.where(~failed), "done")
        batch.unpersist()

    return write
