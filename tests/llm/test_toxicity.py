import random

from sparkwell.llm import toxicity as tx


def fixture():
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "amet") for b in "abcdefghijklmnop"]
    rows = []
    for i in range(400):
        text = [r.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(["scoundrel", "knave", "grimvex", "grimvol", "grimtas"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_model(spark):
    rows = fixture()
    train = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int")
    model = tx.train(train)
    assert {"scoundrel", "knave"} <= set(model.lexicon) and any(w.startswith("grim") for w in model.lexicon)
    assert not any(w.startswith(("lorem", "ipsum", "dolor", "amet")) for w in model.lexicon)
    plain = " ".join(rows[1][1].split()[:40])
    docs = [
        (1, rows[0][1], "x"), (2, rows[1][1], "x"), (3, f"{plain} SC0UNDREL, {plain} kn4ve! scоundrel", "x"), (4, None, "x"), (5, "", "x"),
        (6, f"{plain} grimzzz {plain} grimyyy grimxxx", "x"), (7, plain * 300, "x"), (8, "1234 5678", "x"), (2, rows[1][1], "x"),
    ]
    out = tx.score(spark.createDataFrame(docs, "doc_id bigint, text string, score string"), model)
    got = {x.doc_id: x for x in out.collect()}
    assert out.count() == len(docs) and out.columns.count("score") == 1
    assert {i for i, x in got.items() if x.predicted} == {1, 3, 6}
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= tx.THRESHOLD) for x in got.values())


def test_automaton_against_a_scan():
    r = random.Random(1)
    lexicon = {"ab": 1.0, "abc": 2.0, "b*": 3.0, "bcd*": 4.5, "d": 0.5}
    machine = tx.automaton(lexicon, exceptions=("ab can",))
    for _ in range(300):
        words = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 5))) if r.random() < 0.8 else "can" for _ in range(12)]
        want = hits = 0
        for i, w in enumerate(words):
            fits = [x for k, x in lexicon.items() if w == k or (k.endswith("*") and w.startswith(k[:-1]))]
            if fits and not (w == "ab" and words[i + 1 : i + 2] == ["can"]):
                want, hits = want + max(fits), hits + 1
        got = tx.measure(" ".join(words), machine)
        assert (round(got[0], 9), got[1], got[2]) == (round(want, 9), hits, len(words))


def test_disguises():
    plain = ["idiot"] * 6
    assert tx.folded("\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d ⓘⓓⓘⓞⓣ ïdîöt i.d.i.o.t ｉｄｉｏｔ 1d10t") == plain
    assert tx.folded("I-D-I-O-T, іdіоt \U0001f178\U0001f173\U0001f178\U0001f17e\U0001f183 ɪᴅɪᴏᴛ idi\u200bot i\u0301d\u0301iot") == plain
    assert tx.folded("e.g. a b c 2024 x-ray für") == ["e", "g", "a", "b", "c", "2024", "x", "ray", "fur"]


def test_exceptions_are_learned(spark):
    """A listed word that is harmless beside one other word, though toxic elsewhere."""
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "amet") for b in "abcdefghijklmnop"]
    rows = []
    for i in range(900):
        text = [r.choice(words) for _ in range(40)]
        if i % 5 == 0:
            text[10:10], text[20:20] = ["scoundrel"], ["knave"]
        elif i % 9 == 1:
            text[15:15] = ["scoundrel", "biscuit"]
        rows.append((" ".join(text), int(i % 5 == 0)))
    model = tx.train(spark.createDataFrame(rows, "text string, toxic int"))
    assert "scoundrel biscuit" in model.exceptions and "scoundrel" in model.lexicon and set(tx.EXCEPTIONS) < set(model.exceptions)
    assert not [e for e in model.exceptions if e not in tx.EXCEPTIONS and "biscuit" not in e]
    docs = spark.createDataFrame([(1, "one scoundrel biscuit"), (2, "one scoundrel knave")], "doc_id bigint, text string")
    assert {x.doc_id: x.predicted for x in tx.score(docs, model).collect()} == {1: 0, 2: 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string, toxic int")
    model = tx.train(none)
    assert model.lexicon == {} and model.exceptions == tx.EXCEPTIONS
    assert tx.score(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0
    docs, labels = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int")
    assert tx.labelled_rows(docs, labels).count() == 0


def test_draw_is_bounded_for_repeated_ids(spark):
    docs = spark.createDataFrame([(0, f"t {i}") for i in range(3000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1)], "doc_id bigint, toxic int")
    rows = tx.labelled_rows(docs, labels, most=200).collect()
    assert 100 < len(rows) < 320 and {x.toxic for x in rows} == {1}


def test_nothing_to_learn_from(spark):
    one_kind = spark.createDataFrame([("abc def", 0), (None, 0)], "text string, toxic int")
    model = tx.train(one_kind)
    assert model.lexicon == {}
    out = tx.score(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string"), model).collect()
    assert all(x.predicted == 0 and x.score < 0.01 for x in out)


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held = tx.op9_lexicon_toxicity(spark, folder).where("held_out").join(labels, "doc_id").collect()
    found = sum(x.predicted for x in held if x.toxic)
    assert found > 0.85 * sum(x.toxic for x in held)
    assert sum(x.predicted for x in held if not x.toxic) < 0.01 * len(held)
