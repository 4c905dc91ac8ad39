"""Dead letters driven again: dry, failing, half-way and once more."""

import pytest
from pyspark.sql import functions as F

from sparkwell.operators import dead_letters as dl
from sparkwell.sources import queue as qs


@pytest.fixture()
def store(spark, tmp_path):
    folder = str(tmp_path)
    rows = [("a1", "p", 3, 0, "e", 10, "a", 0), ("a2", "bad", 3, 0, "e", 10, "a", 0), ("a3", "p", 3, 0, "e", 10, "a", 1), ("b1", "p", 5, 0, "e", 10, "b", 0), ("b2", "bad", 5, 0, "e", 10, "b", 0), (None, "bad", None, 0, "e", 10, "b", 0)]
    spark.createDataFrame(rows, dl.LETTER).write.partitionBy("job_type", "batch").parquet(f"{folder}/dead")
    return folder


def held(spark, folder):
    return sorted(((r.job_id, r.attempts) for r in dl.letters(spark, folder).collect()), key=str)


ALL = [("a1", 3), ("a2", 3), ("a3", 3), ("b1", 5), ("b2", 5), (None, None)]
def refused():
    return F.when(F.col("payload") == "bad", "not valid")


def test_dry_run_changes_nothing(spark, store):
    sent = []
    audit = dl.redrive(spark, store, "1", lambda df, t: sent.append(t), now_ms=7, refused=refused(), dry_run=True, by="me").collect()
    assert not sent and held(spark, store) == sorted(ALL, key=str)
    assert {(r.job_id, r.status, r.reason) for r in audit} >= {("a1", "dry-run", "validation passed"), ("a2", "dry-run", "would fail: not valid")} and {r.redriven_by for r in audit} == {"me"}


def test_scheduled_leave_and_failed_stay(spark, store, tmp_path):
    queue = str(tmp_path / "queue")
    send = lambda df, token: qs._add_segments(df, queue, token)
    dl.redrive(spark, store, "1", send, now_ms=7, refused=refused(), job_type="a")
    assert held(spark, store) == sorted([("a2", 4), ("b1", 5), ("b2", 5), (None, None)], key=str)  # a3's partition is gone
    for _ in range(3):  # the same run again and again
        dl.redrive(spark, store, "1", send, now_ms=9, refused=refused(), job_type="a")
    assert held(spark, store) == sorted([("a2", 4), ("b1", 5), ("b2", 5), (None, None)], key=str)
    q = qs.Queue(queue)
    jobs = [j for n in q.segments("waiting") for j in q.jobs(n)]
    assert len(jobs) == 2 and {j[1:4] for j in jobs} == {("a", "p", 0)}
    dl.redrive(spark, store, "2", send, now_ms=8, refused=refused())
    assert held(spark, store) == sorted([("a2", 5), ("b2", 6), (None, 1)], key=str)
    assert {(r.job_type, r.total, r.successful, r.failed) for r in dl.history(spark, store).collect()} == {("a", 4, 2, 2), ("b", 3, 1, 2), (None, 7, 3, 4)}
    dl.redrive(spark, store, "3", send, now_ms=8, chosen=F.col("job_id") == "b2")
    assert held(spark, store) == sorted([("a2", 5), (None, 1)], key=str)


@pytest.mark.parametrize("where", ["sending", "rewriting"])
def test_a_run_that_ended_half_way_goes_on(spark, store, monkeypatch, where):
    sent, real = [], dl._rewrite

    def send(df, token):
        if where == "sending" and not sent:
            sent.append(None)
            raise RuntimeError("queue lost")
        sent.append(sorted(r.job_id for r in df.collect()))

    def rewrite(*args):
        if where == "rewriting":
            monkeypatch.setattr(dl, "_rewrite", real)
            raise RuntimeError("driver lost")
        real(*args)

    monkeypatch.setattr(dl, "_rewrite", rewrite)
    with pytest.raises(RuntimeError):
        dl.redrive(spark, store, "1", send, now_ms=7, refused=refused())
    assert held(spark, store) == sorted(ALL, key=str)  # nothing lost, no attempt counted
    dl.redrive(spark, store, "1", send, now_ms=8, refused=refused())
    assert held(spark, store) == sorted([("a2", 4), ("b2", 6), (None, 1)], key=str)
    assert len({str(s) for s in sent if s}) == 1  # the same jobs under the same names, which a queue takes once


def test_no_store(spark, tmp_path):
    assert dl.letters(spark, str(tmp_path / "none")).count() == 0 and dl.history(spark, str(tmp_path / "none")).count() == 0
