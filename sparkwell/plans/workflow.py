"""Workflows of named steps from DataFrame to DataFrame that know what ran: outputs, states and times are kept, and a rerun goes on."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PENDING, RUNNING, SUCCESS, FAILED, SKIPPED = "pending", "running", "success", "failed", "skipped"


class Step(Protocol):
    """What a workflow runs: a name of its own, and a function of the frame before and the context."""

    name: str

    def run(self, df: DataFrame | None, context: Context) -> DataFrame: ...


@dataclass
class Task:
    """A step from a function of the frame alone, or of the frame and the context."""

    name: str
    work: Callable[..., DataFrame]
    with_context: bool = False

    def run(self, df: DataFrame | None, context: Context) -> DataFrame:
        return self.work(df, context) if self.with_context else self.work(df)


@dataclass
class Record:
    status: str = PENDING
    duration_ms: int | None = None
    rows: int | None = None
    error: str | None = None
    #: Whether an earlier run of the workflow did it.
    resumed: bool = False


@dataclass
class Context:
    """What steps share: ``metadata`` is kept with the workflow's state and must be what JSON can hold."""

    workflow_id: str
    started_ms: int
    steps: dict[str, Record] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass
class Result:
    status: str
    output: DataFrame | None
    context: Context
    duration_ms: int


class Workflow:
    """Runs steps in order under ``folder``, one table for each.

    A step has succeeded once its output is written whole: its time and its state are those of the execution, not of making a plan. Each
    state is written before and after its step, so that whoever looks sees what runs. The first step that fails ends the run, later ones are skipped. A
    run of the same workflow id in the same folder goes on after the last step that succeeded, with the metadata of that moment; if the
    steps are named otherwise than then, it starts anew. ``folder`` must be one that driver and executors share.
    """

    def __init__(self, steps: Sequence[Step], folder: str, workflow_id: str | None = None):
        if not steps:
            raise ValueError("a workflow has at least one step")
        names = [s.name for s in steps]
        if len(set(names)) < len(names):
            raise ValueError("steps must have names of their own")
        self.steps, self.workflow_id = list(steps), workflow_id or uuid.uuid4().hex
        self.root = f"{folder}/{self.workflow_id}"

    def _table(self, i: int) -> str:
        return f"{self.root}/{i:03d}-{re.sub('[^A-Za-z0-9_-]', '_', self.steps[i].name)}"

    def run(self, spark: SparkSession, df: DataFrame | None = None, metadata: dict[str, Any] | None = None) -> Result:
        began = time.time()
        context = Context(self.workflow_id, int(began * 1000), {s.name: Record() for s in self.steps}, dict(metadata or {}))
        done = self._resume(spark, context)
        output = spark.read.parquet(self._table(done - 1)) if done else df
        for i, step in enumerate(self.steps[done:], done):
            record = context.steps[step.name]
            record.status = RUNNING
            self._keep(spark, context)
            started = time.time()
            try:
                step.run(output, context).write.mode("overwrite").parquet(self._table(i))
                output = spark.read.parquet(self._table(i))
                record.rows, record.status = output.count(), SUCCESS
            except Exception as e:  # noqa: BLE001  reported, whatever it is
                record.status, record.error = FAILED, str(e)
            record.duration_ms = int((time.time() - started) * 1000)
            if record.status == FAILED:
                for later in self.steps[i + 1 :]:
                    context.steps[later.name].status = SKIPPED
            self._keep(spark, context)
            if record.status == FAILED:
                return Result(FAILED, None, context, int((time.time() - began) * 1000))
        return Result(SUCCESS, output, context, int((time.time() - began) * 1000))

    def state(self, spark: SparkSession) -> Context | None:
        """The workflow's state as it was last written, by this or another process."""
        fs, path = _path(spark, f"{self.root}/state.json")
        if not fs.exists(path):
            return None
        told = json.loads("\n".join(r.value for r in spark.read.text(f"{self.root}/state.json", wholetext=True).collect()))
        return Context(told["workflow_id"], told["started_ms"], {k: Record(**v) for k, v in told["steps"].items()}, told["metadata"])

    def _resume(self, spark: SparkSession, context: Context) -> int:
        """How many steps are done; takes their records and the metadata over."""
        before = self.state(spark)
        if before is None or list(before.steps) != list(context.steps):
            return 0
        done = 0
        for i, step in enumerate(self.steps):
            fs, path = _path(spark, f"{self._table(i)}/_SUCCESS")
            if before.steps[step.name].status != SUCCESS or not fs.exists(path):
                break
            context.steps[step.name] = before.steps[step.name]
            context.steps[step.name].resumed = True
            done = i + 1
        if done:
            context.metadata = {**before.metadata, **context.metadata}
        return done

    def _keep(self, spark: SparkSession, context: Context) -> None:
        """Writes the state beside the old one, then in its place."""
        fs, path = _path(spark, f"{self.root}/state.json")
        _, new = _path(spark, f"{self.root}/.state.new")
        out = fs.create(new, True)
        out.write(json.dumps(asdict(context)).encode())
        out.close()
        fs.delete(path, False)
        fs.rename(new, path)


def trace(spark: SparkSession, context: Context) -> DataFrame:
    """(workflow_id, place, step, status, duration_ms, rows, error, resumed): a workflow's steps as a table."""
    rows = [(context.workflow_id, i, name, r.status, r.duration_ms, r.rows, r.error, r.resumed) for i, (name, r) in enumerate(context.steps.items())]
    return spark.createDataFrame(rows, "workflow_id string, place int, step string, status string, duration_ms bigint, rows bigint, error string, resumed boolean")


def run_steps(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str | None = None) -> tuple[DataFrame | None, list[dict]]:
    """The result of the last step, or None, and a record (step, status, seconds, error) of each: a workflow of plain functions.

    Each step's output is written under ``folder``, else under ``spark.checkpoint.dir``, or a temporary folder for a master in this process.
    """
    spark = df.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkwell-")
    found = Workflow([Task(name, work) for name, work in steps], folder).run(spark, df)
    told = {SUCCESS: "completed", FAILED: "failed", SKIPPED: "skipped"}
    records = [{"step": k, "status": told[r.status], "seconds": (r.duration_ms or 0) / 1000, "error": r.error} for k, r in found.context.steps.items()]
    return found.output, records


def experiment(
    spark: SparkSession, folder: str, dataset: DataFrame, pipeline: Callable[[DataFrame], DataFrame], evaluators: dict[str, Column], *, snapshot: Column | None = None,
    run_id: str | None = None, **metadata: Any,
) -> tuple[Result, DataFrame | None, DataFrame | None]:
    """(workflow, report, snapshots) of a dataset run through a pipeline and its evaluators, as a workflow that can go on.

    ``dataset`` are questions (id and what the pipeline needs), the pipeline adds their answers, each evaluator is a score over the answered rows. The report has
    each score's number, mean, least and highest; snapshots are ``snapshot`` of each row, null ones left out. What is told of the run is kept in its metadata.
    Report and snapshots are null if a step failed.
    """
    score = lambda df: df.select("*", *[c.alias(f"score_{k}") for k, c in evaluators.items()])
    steps = [Task("dataset", lambda _: dataset), Task("answers", pipeline), Task("scores", score)]
    flow = Workflow(steps, folder, run_id)
    found = flow.run(spark, None, {k: v for k, v in metadata.items() if v is not None})
    if found.output is None:
        return found, None, None
    rows = found.output
    long = rows.unpivot([], [F.col(f"score_{k}") for k in evaluators], "metric", "value").withColumn("metric", F.substring("metric", 7, 1 << 20))
    report = long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("highest"))
    taken = None if snapshot is None else rows.select(snapshot.alias("snapshot")).where("snapshot is not null")
    return found, report, taken


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
