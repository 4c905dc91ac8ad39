import json

from pyspark.sql import functions as F

from sparkwell.sources import files
from sparkwell.streaming import events as ev

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream_of(spark, folder):
    table = spark.read.parquet(EVENTS).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    table.repartitionByRange(3, "ts").write.parquet(str(folder))
    return table, ev.read_events(spark, str(folder), 1)


def run(stream, name, mode, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_match_the_batch(spark, tmp_path):
    table, stream = stream_of(spark, tmp_path / "e")
    got = run(ev.rates(stream, late="40 days"), "rates", "complete", spark)
    want = table.groupBy(F.window("ts", "5 minutes").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.select("start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def test_duplicates_go(spark, tmp_path):
    table, stream = stream_of(spark, tmp_path / "e")
    twice = stream.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    assert run(ev.once(twice, within="40 days"), "once", "append", spark).count() == table.count()


def test_dead_letters(spark):
    rows = spark.createDataFrame([(1, "error", 5), (2, "error", 2), (3, "view", 1)], "event_id bigint, event_type string, attempts int").withColumn("ts", F.current_timestamp())
    out = {}
    ev.split_dead(lambda df, name: out.__setitem__(name, df.collect()))(rows, 0)
    assert {k: [r.event_id for r in v] for k, v in out.items()} == {"dead": [1], "retry": [2], "done": [3]} and out["retry"][0].delay_ms == 2000


def test_rate_limit(spark, tmp_path):
    table, stream = stream_of(spark, tmp_path / "e")
    got = run(ev.limited(stream, most=3, window_ms=10**12, late="40 days"), "limited", "append", spark)
    per_user = table.groupBy("user_id").count().collect()
    assert got.count() == table.count()
    assert got.where("allowed").count() == sum(min(3, r["count"]) for r in per_user)


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("héllo\n\nthere")
    got = files.ingest(spark, "text", str(tmp_path / "t")).first()
    assert got.text == "héllo\n\nthere"
    registry = {"version": 1, "datasets": [{"id": "a", "path": "a.txt", "sha256": got.sha256}, {"id": "b", "path": "b.txt", "sha256": "0"}]}
    (tmp_path / "r.json").write_text(json.dumps(registry))
    checked = files.verify(files.read_registry(spark, str(tmp_path / "r.json")), files.read_texts(spark, str(tmp_path / "t")))
    assert {r.id: r.verified for r in checked.collect()} == {"a": True, "b": False}
    golden = {"name": "g", "version": "1", "entries": [{"id": "1", "question": "q", "expectedChunkIds": ["c"]}, {"id": "2", "question": "q"}]}
    (tmp_path / "g.json").write_text(json.dumps(golden))
    assert {r.id: r.expectedChunkIds for r in files.read_golden(spark, str(tmp_path / "g.json")).collect()} == {"1": ["c"], "2": []}
    (tmp_path / "x.jsonl").write_text('{"component":"rag","operation":"ask","status":"ok","durationMs":-3}\nbroken\n{"component":"rag"}\n')
    traces = files.read_traces(spark, str(tmp_path / "x.jsonl")).collect()
    assert [(t.operation, t.durationMs) for t in traces] == [("ask", 0.0)]


def test_index(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [("t1", "u", 1, "a"), ("t1", "u", 2, "b"), ("t2", "u", 1, "c")]
    files.save_index(spark.createDataFrame(rows, "tenant string, owner string, doc_id bigint, text string"), path)
    files.save_index(spark.createDataFrame([("t1", "u", 2, "B")], "tenant string, owner string, doc_id bigint, text string"), path)
    assert sorted(r.text for r in files.load_index(spark, path, "t1", "u").collect()) == ["B", "a"]
    new = files.upsert(spark.createDataFrame([(1, 1, "old")], "id int, updated_at int, x string"), spark.createDataFrame([(1, 2, "new")], "id int, updated_at int, x string"))
    assert new.first().x == "new"
