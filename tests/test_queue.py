"""A consumer that acknowledges: what was not committed comes again, once."""

from pyspark.sql import functions as F

from sparkwell.sources import queue as qs


def jobs(n, kind="a", first=0):
    return [{"job_id": f"j{first + i}", "job_type": kind, "payload": str(i)} for i in range(n)]


def run(spark, path, checkpoint, each):
    q = qs.read_jobs(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination(180)
    except Exception:  # noqa: BLE001  the batch's own error
        pass
    return q.exception()


def test_commit_is_the_acknowledgement(spark, tmp_path):
    path, at = str(tmp_path / "q"), str(tmp_path / "at")
    queue = qs.Queue(path)
    assert queue.add(jobs(5), "first") == 1 and queue.add(jobs(5), "first") is None and queue.add([]) is None
    seen = []

    def failing(batch, batch_id):
        seen.append(sorted(r.job_id for r in batch.collect()))
        raise RuntimeError("worker lost")

    assert run(spark, path, at, failing) is not None
    assert queue.acknowledged() == 0 and len(queue.segments("waiting")) == 1  # nothing was acknowledged

    def good(batch, batch_id):
        seen.append(sorted(r.job_id for r in batch.collect()))

    assert run(spark, path, at, good) is None
    assert seen == [[f"j{i}" for i in range(5)]] * 2  # again, once
    queue.add(jobs(3, first=5))
    assert run(spark, path, at, good) is None
    assert seen[2:] == [["j5", "j6", "j7"]] and queue.acknowledged() >= 1
    # Another consumer, without the checkpoint, begins behind what was acknowledged.
    queue.acknowledge(2)
    queue.add(jobs(1, first=8))
    assert run(spark, path, str(tmp_path / "other"), good) is None
    assert seen[3:] == [["j8"]]


def test_retries_and_dead_letters(spark, tmp_path):
    path, folder, at = str(tmp_path / "q"), str(tmp_path / "out"), str(tmp_path / "at")
    queue = qs.Queue(path)
    queue.add(jobs(6) + jobs(2, "b", 6) + [{"job_id": "later", "job_type": "a", "not_before_ms": 5000}])
    now, tried = [1000], []

    def work(batch):  # odd jobs fail
        return batch.withColumn("error", F.when(F.col("job_id").rlike("[13579]$"), "odd"))

    each = qs.consumer(path, work, folder, policies={"b": (1, 10)}, now_ms=lambda: now[0])

    def crash_once(batch, batch_id):  # after everything was filed, before Spark knows
        each(batch, batch_id)
        tried.append(batch_id)
        if len(tried) == 1:
            raise RuntimeError("driver lost")

    assert run(spark, path, at, crash_once) is not None
    for _ in range(5):
        assert run(spark, path, at, crash_once) is None
        now[0] += 4000
    assert tried[0] == tried[1]
    done = sorted(r.job_id for r in spark.read.parquet(f"{folder}/done").collect())
    dead = {r.job_id: (r.attempts, r.job_type) for r in spark.read.parquet(f"{folder}/dead").collect()}
    assert done == ["j0", "j2", "j4", "j6", "later"]
    assert dead == {"j1": (3, "a"), "j3": (3, "a"), "j5": (3, "a"), "j7": (1, "b")}
    assert spark.read.parquet(f"{folder}/tried").where("job_id = 'j1'").count() == 3
