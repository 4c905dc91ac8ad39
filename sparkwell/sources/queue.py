"""A job queue in a shared folder: a streaming source whose commit is the acknowledgement, and a consumer with retries and dead letters."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

JOB = "job_id string, job_type string, payload string, attempts int, not_before_ms bigint"
_FIELDS = [c.split()[0] for c in JOB.split(", ")]
_SEGMENT = re.compile(r"(\d{20})\.([\w-]+)\.jsonl")
#: Attempts that a job of a kind has, and the first delay, which doubles; what a kind without a policy gets.
POLICIES: dict[str, tuple[int, int]] = {}
DEFAULT_POLICY = (3, 1000)


class Queue:
    """Segments of jobs under ``path``: ``waiting``, then ``acknowledged``. Any store that pyarrow opens will do.

    A segment's name has its number and a token; a token that is there already is not added again, so adding can be repeated after a failure. One
    process adds at a time; readers are as many as there are segments.
    """

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def segments(self, part: str) -> dict[int, tuple[str, str]]:
        """Number to (token, path)."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{part}", allow_not_found=True))
        named = ((_SEGMENT.fullmatch(f.base_name), f.path) for f in found)
        return {int(m[1]): (m[2], path) for m, path in named if m}

    def add(self, jobs: Sequence[dict], token: str | None = None) -> int | None:
        """Adds one segment and returns its number; None if there are no jobs or the token is known."""
        waiting, done = self.segments("waiting"), self.segments("acknowledged")
        if not jobs or token in {t for t, _ in [*waiting.values(), *done.values()]}:
            return None
        number = max([0, *waiting, *done]) + 1
        lines = [json.dumps({"job_id": None, "job_type": None, "payload": None, "attempts": 0, "not_before_ms": 0} | j) for j in jobs]
        self.fs.create_dir(f"{self.root}/waiting")
        name = f"{number:020d}.{token or uuid.uuid4().hex}.jsonl"
        with self.fs.open_output_stream(f"{self.root}/waiting/.{name}") as out:
            out.write("\n".join(lines).encode())
        self.fs.move(f"{self.root}/waiting/.{name}", f"{self.root}/waiting/{name}")  # whole or not at all
        return number

    def acknowledge(self, number: int) -> None:
        """Segments up to ``number`` leave the queue."""
        self.fs.create_dir(f"{self.root}/acknowledged")
        for n, (_, path) in self.segments("waiting").items():
            if n <= number:
                self.fs.move(path, f"{self.root}/acknowledged/{path.rsplit('/', 1)[-1]}")

    def acknowledged(self) -> int:
        return max([0, *self.segments("acknowledged")])

    def jobs(self, number: int) -> Iterator[tuple]:
        """A segment's jobs, wherever it is by now: a batch may be run again after its successor's acknowledgement began."""
        for part in ("waiting", "acknowledged"):
            if number in (found := self.segments(part)):
                with self.fs.open_input_stream(found[number][1]) as file:
                    for line in file.read().decode().splitlines():
                        job = json.loads(line)
                        yield tuple(job[f] for f in _FIELDS)
                return
        raise FileNotFoundError(f"segment {number} of {self.root}")


class Segment(InputPartition):
    def __init__(self, number: int):
        self.number = number


class QueueReader(DataSourceStreamReader):
    """Offsets are segment numbers. Spark commits an offset once the batch up to it is done: that acknowledges its segments."""

    def __init__(self, path: str):
        self.queue = Queue(path)

    def initialOffset(self) -> dict:
        return {"segment": self.queue.acknowledged()}

    def latestOffset(self) -> dict:
        return {"segment": max([self.queue.acknowledged(), *self.queue.segments("waiting")])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known = {**self.queue.segments("waiting"), **self.queue.segments("acknowledged")}
        return [Segment(n) for n in sorted(known) if start["segment"] < n <= end["segment"]]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return self.queue.jobs(partition.number)

    def commit(self, end: dict) -> None:
        self.queue.acknowledge(end["segment"])


class JobQueue(DataSource):
    """``spark.readStream.format("job_queue").option("path", folder)``: the jobs of a ``Queue``, one partition for each segment."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return JOB

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options["path"])


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(JobQueue)
    return spark.readStream.format("job_queue").option("path", path).load()


def policy_of(policies: dict[str, tuple[int, int]], place: int):
    """Attempts (place 0) or first delay (place 1) of a row's job type."""
    found = F.lit(DEFAULT_POLICY[place])
    for kind, policy in policies.items():
        found = F.when(F.col("job_type") == kind, F.lit(policy[place])).otherwise(found)
    return found


def consumer(path: str, work: Callable[[DataFrame], DataFrame], folder: str, *, policies: dict[str, tuple[int, int]] = POLICIES, now_ms: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on ``read_jobs``: does the jobs and files what became of them.

    ``work`` gets JOB rows and returns them with a column ``error`` (null: done). Done jobs go to ``folder/done``, jobs whose attempts are used
    up to ``folder/dead`` by job type, others are added to the queue again with one attempt more and a doubled delay; jobs whose time has not come
    are added again as they are. A job id that is done already is skipped. All of it is named by the batch, so a
    batch that failed half-way and is run again writes the same once more. Null job ids are never skipped as done.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, now_ms()
        done_at = f"{folder}/done"
        fresh = batch
        if _exists(spark, done_at):
            fresh = batch.join(spark.read.parquet(done_at).where(F.col("batch") != batch_id).select("job_id").distinct(), "job_id", "left_anti")
        due = F.coalesce("not_before_ms", F.lit(0)) <= now
        work(fresh.where(due)).select(*_FIELDS, "error").write.mode("overwrite").parquet(f"{folder}/tried/batch={batch_id}")
        tried = spark.read.parquet(f"{folder}/tried/batch={batch_id}").withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1)
        failed, used_up = F.col("error").isNotNull(), F.col("attempts") >= policy_of(policies, 0)
        tried.where(~failed).write.mode("overwrite").parquet(f"{done_at}/batch={batch_id}")
        dead = tried.where(failed & used_up).withColumn("failed_at_ms", F.lit(now)).withColumn("batch", F.lit(batch_id))
        dead.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_type", "batch").parquet(f"{folder}/dead")
        delay = policy_of(policies, 1) * F.pow(F.lit(2.0), F.col("attempts") - 1)
        again = tried.where(failed & ~used_up).withColumn("not_before_ms", (F.lit(now) + delay).cast("bigint")).select(*_FIELDS)
        waiting = fresh.where(~due).select(*_FIELDS)
        # Segments are written where the rows are; the queue's folder gets names only.
        _add_segments(again.unionByName(waiting), path, f"retry-{batch_id}")

    return run


def _add_segments(jobs: DataFrame, path: str, token: str) -> None:
    """Adds jobs as one segment from each task's rows, then by name, so that no job goes through the driver."""

    def stage(batches):
        import pandas as pd
        from pyspark import TaskContext

        rows = [r for b in batches for r in json.loads(b.to_json(orient="records"))]
        if rows:
            q, part = Queue(path), TaskContext.get().partitionId()
            q.fs.create_dir(f"{q.root}/staged")
            with q.fs.open_output_stream(f"{q.root}/staged/{token}-{part}.jsonl") as out:
                out.write("\n".join(map(json.dumps, rows)).encode())
            yield pd.DataFrame({"part": [part]})

    from ..session import ship

    ship(jobs.sparkSession)
    queue = Queue(path)
    for row in sorted(jobs.mapInPandas(stage, "part int").distinct().collect()):  # a number for each task
        known = {t for part in ("waiting", "acknowledged") for t, _ in queue.segments(part).values()}
        name = f"{token}-{row.part}"
        if name not in known:
            number = max([0, *queue.segments("waiting"), *queue.segments("acknowledged")]) + 1
            queue.fs.create_dir(f"{queue.root}/waiting")
            queue.fs.move(f"{queue.root}/staged/{name}.jsonl", f"{queue.root}/waiting/{number:020d}.{name}.jsonl")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
