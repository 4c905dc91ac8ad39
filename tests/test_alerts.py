"""Quantiles from buckets, alerts that hold, and rings of the newest values, in batch and stream."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwell.operators import alerts
from sparkwell.plans import QUERIES, alerting
from sparkwell.streaming import alerts as stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SF = "/root/testdata/sf0.001"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def quantile(q, bounds, counts):
    total = counts[-1]
    if not total:
        return None
    rank, before, start = q * total, 0, min(bounds[0], 0)
    for i, (end, n) in enumerate(zip(bounds, counts, strict=False)):
        if n >= rank:
            if i == 0 and end <= 0:
                return end
            return start + (end - start) * ((rank - before) / (n - before) if n > before else 0)
        before, start = n, end
    return bounds[-1]


def test_histogram_quantile(spark):
    r = random.Random(3)
    for bounds in ([1.0, 2.0, 5.0], [-1.0, 0.0, 3.0], [7.0]):
        rows = [(g, r.choice([None, r.uniform(-3, 9)])) for g in range(12) for _ in range(g)] + [(50, None), (51, 100.0), (52, 0.5)]
        found = spark.createDataFrame(rows, "g int, v double").groupBy("g").agg(alerts.bucket_counts(F.col("v"), bounds).alias("c"))
        qs = (0.0, 0.25, 0.5, 0.99, 1.0)
        for row in found.select("g", "c", *[alerts.histogram_quantile(q, bounds, F.col("c")).alias(f"q{i}") for i, q in enumerate(qs)]).collect():
            values = [v for g, v in rows if g == row.g and v is not None]
            assert list(row.c) == [*(sum(v <= b for v in values) for b in bounds), len(values)]
            for i, q in enumerate(qs):
                want = quantile(q, bounds, list(row.c))
                assert row[f"q{i}"] == want or math.isclose(row[f"q{i}"], want)
    with pytest.raises(ValueError):
        alerts.histogram_quantile(1.5, [1.0], F.col("c"))
    with pytest.raises(ValueError):
        alerts.histogram_quantile(0.5, [2.0, 1.0], F.col("c"))


def told(rows):
    return sorted((r.alert, r.at, r.state, None if r.since is None or r.since != r.since else int(r.since)) for r in rows)


def test_states_hold(spark):
    values = [(0, 1.0), (60, 1.0), (120, 1.0), (180, 0.0), (240, 1.0), (360, 1.0), (420, 1.0), (480, None), (540, 1.0)]
    df = spark.createDataFrame([("a", at, v) for at, v in values] + [("b", 0, 1.0)], "alert string, at bigint, value double")
    got = told(alerts.states(df, ["alert"], F.col("value") > 0.5, 120, 60).collect())
    P, Fi, I = "pending", "firing", "inactive"  # noqa: E741
    want = [(0, P, 0), (60, P, 0), (120, Fi, 0), (180, I, None), (240, P, 240), (360, P, 360), (420, P, 360), (480, I, None), (540, P, 540)]
    assert got == sorted([("a", *w) for w in want] + [("b", 0, P, 0)])


def test_stream_states_equal_the_batch(spark, tmp_path, rocks):
    rows = alerting.evaluations(lambda name: spark.read.parquet(f"{SF}/{name}.parquet")).cache()
    want = told(alerts.states(rows, ["alert"], F.col("over"), F.col("hold_s"), alerting.STEP_S).collect())
    assert len({w[2] for w in want}) == 3
    cuts = rows.approxQuantile("at", [0.3, 0.6], 0.0)
    folder, schema = str(tmp_path / "in"), rows.schema
    for part in (F.col("at") <= cuts[0], (F.col("at") > cuts[0]) & (F.col("at") <= cuts[1]), F.col("at") > cuts[1]):
        rows.where(part).coalesce(1).write.mode("append").parquet(folder)
        q = stream.held(spark.readStream.schema(schema).parquet(folder), alerting.STEP_S).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(240)
        assert q.exception() is None
    rows.unpersist()
    assert told(spark.read.parquet(str(tmp_path / "out")).collect()) == want


@pytest.mark.parametrize("size", [512, 40])
def test_rings_equal_the_batch(spark, tmp_path, rocks, size):
    """Events replayed in parts, out of order within them and with a restart between."""
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("queue"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"), "value")
    folder, latest = str(tmp_path / "in"), {}

    def keep(batch, _):
        latest.update({r.queue: r for r in batch.collect()})

    for i in range(3):
        events.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i).repartition(2).write.mode("append").parquet(folder)
        q = stream.rings(spark.readStream.schema(events.schema).parquet(folder), size).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    rows: dict = {}
    for r in events.collect():
        rows.setdefault(r.queue, []).append((r.ts, r.id, r.value))
    assert latest.keys() == rows.keys()
    for queue, some in rows.items():
        v = sorted(x[2] for x in sorted(some)[-size:])
        r = latest[queue]
        assert (r.n, r.p95_nearest) == (len(v), v[math.ceil(0.95 * len(v)) - 1]) and np.isclose(r.p95, np.quantile(v, 0.95)) and np.isclose(r.mean, np.mean(v))
    if size == 512:
        batch = {r.queue: r.p95 for r in QUERIES["queue_p95_interpolated"](spark, SF).collect()}
        nearest = {r.queue: r.p95 for r in QUERIES["queue_p95_nearest"](spark, SF).collect()}
        assert all(abs(batch[k] - r.p95) < 0.0051 and abs(nearest[k] - r.p95_nearest) < 0.0051 for k, r in latest.items())
