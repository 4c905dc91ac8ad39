import random

import numpy as np

from sparkwell.llm import language_id as li

SOUNDS = {"xa": ["ka", "lo", "mi", "tu"], "yb": ["sch", "ung", "ein", "öd"], "zc": ["ção", "ñes", "lla", "que"]}


def sentence(lang, n, r):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def fixture():
    r = random.Random(6)
    rows = [(i, sentence(lang, 30, r), lang if i % 5 else None, "clash") for i, lang in enumerate(list(SOUNDS) * 40)]
    return r, rows


def test_predictions(spark):
    r, rows = fixture()
    mixed = sentence("xa", 60, r) + " " + sentence("yb", 20, r)
    odd = [(900, None, "xa", ""), (901, "", "xa", ""), (902, "123 !? 45", "yb", ""), (903, "ñes", None, ""), (904, mixed, None, ""), (905, sentence("zc", 30_000, r), None, "")]
    docs = spark.createDataFrame(rows + odd + rows[:2], "doc_id bigint, text string, lang string, score string")
    model = li.train(docs.where(~li.held_out()))
    assert model[0] == ["xa", "yb", "zc"]
    out = li.predict(docs, model)
    assert out.columns.count("score") == 1
    got = {x.doc_id: x for x in out.collect()}
    truth = {i: list(SOUNDS)[i % 3] for i in range(len(rows))}
    assert all(got[i].lang_pred == truth[i] and got[i].score > 0.9 for i in truth)
    assert all(got[i].lang_pred == li.UNKNOWN and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "zc" and got[905].lang_pred == "zc"
    assert set(got[904].lang_shares) == {"xa", "yb"} and 0.6 < got[904].score < 0.9


def test_expectation_maximisation_against_a_grid():
    r = np.random.default_rng(2)
    logs = np.log(r.dirichlet(np.ones(50), 3)).T
    counts = np.round(400 * (0.7 * np.exp(logs[:, 0]) + 0.3 * np.exp(logs[:, 1])))
    share, likelihood = li.proportions(counts, logs, (0, 1))
    grid = [float(counts @ np.log(p * np.exp(logs[:, 0]) + (1 - p) * np.exp(logs[:, 1]))) for p in np.linspace(0.001, 0.999, 999)]
    assert abs(share[0] - np.linspace(0.001, 0.999, 999)[int(np.argmax(grid))]) < 0.02
    assert likelihood <= max(grid) + 0.5 and likelihood > max(grid) - 0.5


def test_choice_of_languages_against_all_sets():
    """The greedy choice is the best of all sets by penalised likelihood, for one to all of five languages."""
    from itertools import combinations

    r = np.random.default_rng(5)
    logs = np.log(r.dirichlet(np.full(80, 0.3), 5) * 0.98 + 0.02 / 80).T
    for k in range(1, 6):
        members = r.choice(5, k, replace=False)
        share = r.dirichlet(np.full(k, 8.0))
        found = r.choice(80, 4000, p=np.exp(logs[:, members]) @ share / (np.exp(logs[:, members]) @ share).sum())
        got, likelihood = li.identify(found, logs)
        kinds, counts = np.unique(found, return_counts=True)
        penalty = 0.5 * np.log(counts.sum()) + np.log(5)
        worth = {s: li.proportions(counts.astype(float), logs[kinds], s)[1] - penalty * (len(s) - 1) for n in range(1, 6) for s in combinations(range(5), n)}
        best = max(worth, key=worth.get)
        assert tuple(np.flatnonzero(got)) == best == tuple(sorted(members)) and abs(likelihood - penalty * (k - 1) - worth[best]) < 1
        assert np.abs(got[members] - share).max() < 0.05


def test_draw_is_bounded_for_repeated_and_missing_ids(spark):
    rows = [(None if i % 2 else 0, f"text {i}", "xa") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert li.labelled_rows(docs).count() == 4000
    assert 300 < li.labelled_rows(docs, most=500).count() < 700
    drawn = {tuple(r) for r in li.labelled_rows(docs, most=500).collect()}
    assert drawn == {tuple(r) for r in li.labelled_rows(docs.repartition(7, "text"), most=500).collect()}  # however the rows lie
    same = spark.createDataFrame([(None, "one text", "xa")] * 4000, docs.schema)
    assert li.labelled_rows(same, most=500).count() < 700


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "xa")], "doc_id bigint, text string, lang string")
    model = li.train(docs)
    assert model[0] == []
    assert {x.lang_pred for x in li.predict(docs, model).collect()} == {li.UNKNOWN}
    assert li.predict(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    out = li.op1_language_mixture(spark, folder)
    assert out.count() == docs.count()
    held = out.where("held_out").join(docs, "doc_id").collect()
    assert sum(x.lang == x.lang_pred for x in held) > 0.98 * len(held)
