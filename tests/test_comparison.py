"""Snapshots part by part, and every threshold that decides on a variant."""

import pytest

from sparkwell.operators import comparison as cm


def shot(id, chunks, reranking=(), answer="yes", grounded=True, model="m", provider="p", embedding="e", cost=0.0, latency=0.0):
    return (id, chunks, None if reranking is None else list(reranking), answer, grounded, model, provider, embedding, cost, latency)


def compared(spark, before, after):
    frame = lambda rows: spark.createDataFrame(rows, cm.SNAPSHOT)
    return {r.id: r for r in cm.compare_snapshots(frame(before), frame(after)).collect()}


def test_parts_of_snapshots(spark):
    base = [("a", 1, 0.9), ("b", 2, 0.5), ("c", 3, 0.1)]
    before = [shot(i, base) for i in range(1, 10)] + [shot(20, base), shot(30, None, None, None, None), shot(31, [("a", 1, 0.9), ("a", 2, 0.1)]), shot(32, [("a", 1, None)])]
    after = [
        shot(1, base, answer=" yes \n"), shot(2, [("b", 1, 0.5), ("a", 2, 0.9), ("d", 3, 0.2)]), shot(3, [("a", 1, 0.9004), ("b", 2, 0.4), ("c", 3, 0.1)]), shot(4, base, [("a", 2, 1, 0.1)]),
        shot(5, base, answer="no"), shot(6, base, grounded=False), shot(7, base, model="n"), shot(8, base, provider="q", embedding="f"), shot(9, base, cost=0.12345678, latency=-2.0004),
        shot(21, base), shot(30, None, None, None, None), shot(31, [("a", 1, 0.9)]), shot(32, [("a", 1, 0.4)]),
    ]
    got = compared(spark, before, after)
    flags = lambda r: {f for f in ("response", "retrieval", "groundedness", "model", "provider", "embedding", "order", "scores", "reranking") if r[f"{f}_changed"]}
    assert {i: flags(got[i]) for i in range(1, 10)} == {
        1: set(), 2: {"retrieval", "order"}, 3: {"retrieval", "scores"}, 4: {"retrieval", "reranking"}, 5: {"response"}, 6: {"groundedness"}, 7: {"model"}, 8: {"provider", "embedding"}, 9: set()
    }
    assert (got[2].added, got[2].removed, got[2].reordered) == (["d"], ["c"], ["a", "b"])
    assert [(d.chunk_id, d.delta) for d in got[3].score_deltas] == [("b", -0.1)]  # three digits: 0.0004 is none
    assert (got[9].cost_delta, got[9].latency_delta, got[9].status) == (0.123457, -2.0, "matched")
    assert (got[20].missing_in, got[20].status, got[21].missing_in) == ("replay", "diverged", "original")
    assert got[30].status == got[31].status == "matched" and [d.delta for d in got[32].score_deltas] == [None]
    said = cm.compare_snapshots(spark.createDataFrame(before, cm.SNAPSHOT), spark.createDataFrame(after, cm.SNAPSHOT)).select("id", cm.summary().alias("s")).where("id in (1, 8)").orderBy("id").collect()
    assert said[0].s[0] == "The answer stayed the same." and len(said[0].s) == 5 and said[1].s[-1] == "Another provider was used."


def run(variant, id, answer="same", f=0.5, rel=0.5, rec=0.5, g=0.5, q=0.5, lat=100.0, cost=0.01, refused=False):
    return (variant, id, answer, f, rel, rec, g, q, lat, cost, refused)


def decide(spark, **change):
    """The decision on a candidate that differs from the baseline in the means given."""
    rows = [run("base", i) for i in range(10)] + [run("new", i, **change) for i in range(10)]
    return cm.decision(spark.createDataFrame(rows, cm.RUN), "base").first()


CASES = [
    (dict(g=0.47), ["groundedness"], [], "block"), (dict(g=0.53, q=0.51), [], ["groundedness"], "promote"), (dict(rec=0.48), ["recall"], [], "block"), (dict(rec=0.515), [], ["recall"], "manual_review"),
    (dict(lat=106.0), ["latency"], [], "block"), (dict(lat=104.0, q=0.6), [], ["quality"], "promote"), (dict(lat=90.0, q=0.501), [], ["latency"], "promote"), (dict(cost=0.0112), ["cost"], [], "block"),
    (dict(cost=0.0105, q=0.53), [], ["quality"], "promote"), (dict(refused=True), ["refusals"], [], "block"), (dict(answer="other"), ["answers"], [], "block"), (dict(answer="other", q=0.53), [], ["quality"], "promote"),
    (dict(answer=" same  "), [], [], "manual_review"), (dict(q=0.4), [], [], "manual_review"),
]


@pytest.mark.parametrize(("change", "worse", "better", "verdict"), CASES)
def test_every_threshold(spark, change, worse, better, verdict):
    d = decide(spark, **change)
    assert (d.regressions, d.improvements, d.recommendation) == (worse, better, verdict)


def test_the_best_other_is_the_candidate(spark):
    rows = [run("base", 1, q=0.9), run("b", 1, q=0.5), run("a", 1, q=0.7), run("c", 1, q=0.7), run("a", 2, q=0.7, answer="new question")]
    d = cm.decision(spark.createDataFrame(rows, cm.RUN), "base").first()
    assert (d.candidate, d.winner, d.response_change_rate) == ("a", "base", 0.5)
    assert cm.decision(spark.createDataFrame(rows[:1], cm.RUN), "base").count() == 0
    assert cm.decision(spark.createDataFrame(rows[1:], cm.RUN), "base").count() == 0


def test_affected_questions(spark):
    rows = [run("base", i) for i in range(7)]
    rows += [run("new", 0), run("new", 1, answer="x"), run("new", 2, g=0.47, rec=0.4), run("new", 3, cost=0.02, lat=102.0), run("new", 4, refused=True), run("new", 5, lat=100.5), run("new", 9, answer="", g=None, rec=0.0, cost=0.0, lat=0.0)]
    got = {r.query_id: (r.response_changed, r.reasons) for r in cm.affected(spark.createDataFrame(rows, cm.RUN), "base", "new").collect()}
    assert got == {1: (True, []), 2: (False, ["groundedness_drop", "recall_drop"]), 3: (False, ["cost_increase", "latency_increase"]), 4: (False, ["new_refusal"])}
    m = {r.variant: r for r in cm.variant_metrics(spark.createDataFrame(rows, cm.RUN)).collect()}
    assert m["new"].n == 7 and abs(m["new"].refusal_rate - 1 / 7) < 1e-12
