"""Workflows: what ran, what failed while it ran, and where a rerun goes on."""

import pytest
from pyspark.sql import functions as F

from sparkwell.plans import workflow as wf


def test_a_step_that_fails_when_it_runs_has_failed(spark, tmp_path):
    broken = wf.Task("break", lambda d: d.withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("row 2 is bad"))).otherwise(F.lit(1))))
    flow = wf.Workflow([wf.Task("take", lambda d: d.where("id > 0")), broken, wf.Task("after", lambda d: d)], str(tmp_path), "one")
    found = flow.run(spark, spark.range(4))
    assert found.status == "failed" and found.output is None
    assert [r.status for r in found.context.steps.values()] == ["success", "failed", "skipped"]
    assert "row 2 is bad" in found.context.steps["break"].error and found.context.steps["take"].rows == 3
    assert [(r.step, r.status, r.rows) for r in wf.trace(spark, flow.state(spark)).orderBy("place").collect()] == [("take", "success", 3), ("break", "failed", None), ("after", "skipped", None)]
    _, told = wf.run_steps(spark.range(4), [("break", broken.work), ("after", lambda d: d)], str(tmp_path))
    assert [t["status"] for t in told] == ["failed", "skipped"]


def test_a_rerun_goes_on_after_the_last_success(spark, tmp_path):
    ran, fail = [], [True]

    def count(name, work):
        def step(d, context):
            ran.append(name)
            context.metadata[name] = len(ran)
            return work(d)

        return wf.Task(name, step, with_context=True)

    def second(d):
        if fail[0]:
            raise RuntimeError("driver lost")
        return d.withColumn("y", F.col("id") * 2)

    flow = lambda: wf.Workflow([count("a", lambda d: d.where("id > 1")), count("b", second), count("c", lambda d: d.agg(F.sum("y").alias("s")))], str(tmp_path), "w")
    first = flow().run(spark, spark.range(5), {"by": "me"})
    assert (first.status, ran) == ("failed", ["a", "b"])
    fail[0] = False
    again = flow().run(spark, spark.range(5))
    assert again.status == "success" and ran == ["a", "b", "b", "c"] and again.output.first().s == 18
    assert [r.resumed for r in again.context.steps.values()] == [True, False, False]
    assert again.context.metadata == {"by": "me", "a": 1, "b": 3, "c": 4}
    flow().run(spark, spark.range(5))
    assert ran == ["a", "b", "b", "c"]  # all was done
    other = wf.Workflow([count("a", lambda d: d), count("z", lambda d: d)], str(tmp_path), "w").run(spark, spark.range(5))
    assert other.output.count() == 5 and ran[4:] == ["a", "z"]  # other steps: anew


def test_a_half_written_output_is_written_again(spark, tmp_path):
    ran = []
    step = wf.Task("a", lambda d: (ran.append(1), d)[1])
    wf.Workflow([step], str(tmp_path), "w").run(spark, spark.range(3))
    (tmp_path / "w" / "000-a" / "_SUCCESS").unlink()
    assert wf.Workflow([step], str(tmp_path), "w").run(spark, spark.range(3)).output.count() == 3 and len(ran) == 2


def test_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        wf.Workflow([], str(tmp_path))
    with pytest.raises(ValueError):
        wf.Workflow([wf.Task("a", lambda d: d)] * 2, str(tmp_path))
    assert wf.Workflow([wf.Task("a", lambda d: d)], str(tmp_path)).state(spark) is None


def test_experiment(spark, tmp_path):
    questions = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "id int, q string")
    answer = lambda d: d.withColumn("answer", F.upper("q"))
    scores = {"length": F.length("answer").cast("double"), "known": F.col("answer").isNotNull().cast("double")}
    found, report, shots = wf.experiment(spark, str(tmp_path), questions, answer, scores, snapshot=F.when(F.col("answer").isNotNull(), F.struct("id", "answer")), run_id="x", model="m", note=None)
    assert found.status == "success" and found.context.metadata == {"model": "m"}
    assert {r.metric: (r.n, r.mean, r.least, r.highest) for r in report.collect()} == {"length": (2, 2.0, 1.0, 3.0), "known": (3, 2 / 3, 0.0, 1.0)}
    assert sorted(r.snapshot.answer for r in shots.collect()) == ["A B", "C"]
    bad = wf.experiment(spark, str(tmp_path), questions, lambda d: d.select(F.raise_error(F.lit("no"))), scores)
    assert bad[0].status == "failed" and bad[1] is None
