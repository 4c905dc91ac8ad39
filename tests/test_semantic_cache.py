"""The cache in batch and stream against a plain list of entries."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkwell.operators import semantic_cache as sc
from sparkwell.plans import QUERIES
from sparkwell.streaming import cache

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime.datetime(2024, 1, 1)


def made(n, drops, seed=1):
    r = random.Random(seed)
    vectors = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    vectors += [[x + r.gauss(0, 0.05) for x in v] for v in vectors] + [[0.0] * 8, [1.0, 2.0]]
    out, at = [], 0
    for i in range(n):
        at += r.choice([0, 1, 400])
        x = r.random()
        op = "put" if x < 0.5 else "lookup" if x < 0.97 else "invalidate"
        version = r.choice(["a", "b", None]) if op != "invalidate" else (r.choice(["a", None]) if drops else None)
        ms = START + datetime.timedelta(milliseconds=at)
        out.append((i, ms, r.choice([1, 1, 1, 2]), op, version, r.choice(["c", "d"]), r.choice(["q", None]), r.choice(vectors) if r.random() < 0.97 else None, r.choice([None, 3000]), r.choice([None, 0.5])))
    return out


def similar(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size > 0 and len(a) == len(b) else 0.0


def brute(rows, most):
    store, out = {}, {}
    for i, at, index, op, version, context, _, v, ttl, threshold in sorted(rows, key=lambda r: (r[1], r[0])):
        held, v, threshold = store.setdefault(index, []), v or [], threshold or 0.92
        if op == "put":
            held.insert(0, (i, at, ttl or 5000, version or "", context, v))
            del held[most:]
        elif op == "invalidate":
            store[index] = [e for e in held if version is not None and e[3] != version]
        else:
            fits = [e for e in held if (at - e[1]).total_seconds() * 1000 <= e[2] and e[3] == (version or "") and e[4] == context]
            best = max(fits, key=lambda e: round(similar(v, e[5]), 9), default=None)
            score = similar(v, best[5]) if best else None
            reason = (sc.HIT if score >= threshold else sc.BELOW) if best else sc.NO_MATCH if held else sc.NO_ENTRIES
            out[i] = (reason, best[0] if best else None, None if score is None else round(score, 6))
    return out


def told(rows):
    return {r.request_id: (r.reason, r.entry_id, None if r.similarity is None else round(r.similarity, 6)) for r in rows}


@pytest.mark.parametrize("most", [100, 7, 1])
def test_batch(spark, most):
    rows = made(600, drops=False)
    df = spark.createDataFrame(rows, cache.REQUEST).withColumn("at_ms", F.unix_millis("at")).drop("at").repartition(4)
    got = told(sc.lookups(df, most=most, ttl_ms=5000).collect())
    want = brute(rows, most)
    assert got == want and len({x[0] for x in want.values()}) == 4


def test_batch_drops_versions(spark):
    rows = made(500, drops=True, seed=4)
    df = spark.createDataFrame(rows, cache.REQUEST).withColumn("at_ms", F.unix_millis("at")).drop("at")
    got, want = told(sc.lookups(df, ttl_ms=5000).collect()), brute(rows, 100)
    found = lambda x: {i: v[1:] for i, v in x.items() if v[1] is not None}
    assert found(got) == found(want)
    assert sc.lookups(df.limit(0)).count() == 0


def test_spans_do_not_show(spark):
    rows = spark.createDataFrame(made(300, drops=True), cache.REQUEST).withColumn("at_ms", F.unix_millis("at")).select("request_id", "at_ms", "index_id", "op", "version")
    numbers = [sorted(map(tuple, sc.numbered(rows, span).select("request_id", "puts", "wipes", "drops").collect())) for span in (1, 700, 10**12)]
    assert numbers[0] == numbers[1] == numbers[2]


def test_every_fate_of_an_entry(spark):
    total = QUERIES["semantic_cache_contents"](spark, "/root/testdata/sf0.01").agg(*[F.sum(c).alias(c) for c in ("invalidated", "evicted", "expired", "live", "stored")]).first()
    assert min(total) > 0 and total.stored == total.invalidated + total.evicted + total.expired + total.live
    reasons = {r.reason for r in QUERIES["semantic_cache_rates"](spark, "/root/testdata/sf0.01").where("reason is not null").collect()}
    assert len(reasons) == 4


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Two runs of one query, files in between: what the first put the second finds."""
    rows = made(240, drops=True, seed=9)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    try:
        for part in (rows[:120], rows[120:]):
            spark.createDataFrame(part, cache.REQUEST).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(cache.REQUEST).parquet(folder)
            q = cache.cached(stream, most=7, ttl_ms=5000, late="1 day").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(out)
            q.awaitTermination(240)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(out)
    assert got.count() == len(rows)
    looked = got.where("op = 'lookup'").collect()
    assert told(looked) == brute(rows, 7)
    hits: dict = {}
    for r in sorted((r for r in looked if r.hit), key=lambda r: (rows[r.request_id][1], r.request_id)):
        hits[r.entry_id] = hits.get(r.entry_id, 0) + 1
        assert r.hits == hits[r.entry_id]
    assert got.where("op = 'put'").agg(F.max("held")).first()[0] == 7 and got.where("evicted > 0").count() > 0


def test_idle_indexes_lose_their_state(spark, tmp_path):
    day = datetime.timedelta(days=1)
    rows = [(1, START, 1, "put", "a", "c", "q", [1.0], None, None), (2, START + day, 2, "put", "a", "c", "q", [1.0], None, None), (3, START + 2 * day, 2, "lookup", "a", "c", "q", [1.0], 0, None)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        folder = str(tmp_path / "in")
        for i, row in enumerate([*rows, (4, START + 2 * day, 1, "lookup", "a", "c", "q", [1.0], None, None)]):
            spark.createDataFrame([row], cache.REQUEST).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(cache.REQUEST).parquet(folder)
            q = cache.cached(stream, late="1 minute").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
            q.awaitTermination(240)
            assert q.exception() is None, i
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.request_id: r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[4] == sc.NO_ENTRIES and got[3] in (sc.NO_MATCH, sc.NO_ENTRIES)
