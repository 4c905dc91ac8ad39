import numpy as np
import pytest

import corpus_pipeline as cp
from sparkwell.llm import language_id, tokens, toxicity

from .test_shingles import brute_near_copies
from .test_simhash import brute_components, brute_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with odd rows added."""
    at = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    odd = [(90001, None, "en", "s", 0), (90002, "123 456", "en", "s", 7), (90003, f"and {item} and more of it", None, None, None), (90004, docs.first().text + " x", "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).coalesce(1).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return str(at)


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    run = lambda k, rows: sorted(r.doc_id for r in cp.STAGES[k][1](spark, spark.createDataFrame(rows, spark.read.parquet(f"{folder}/documents.parquet").schema), folder).collect())

    kept = [d for d in docs if any(c.isalpha() for c in d.text or "")]
    assert run(0, docs) == [d.doc_id for d in kept] and len(kept) == len(docs) - 2

    frame = spark.createDataFrame(kept, spark.read.parquet(f"{folder}/documents.parquet").schema)
    model = toxicity.train(toxicity.labelled_rows(frame, spark.read.parquet(f"{folder}/labels.parquet")))
    machine = toxicity.automaton(model.lexicon)
    chance = lambda t: 1 / (1 + np.exp(-(toxicity.evidence(*toxicity.measure(t, machine)) * model.slope + model.offset)))
    clean = [d for d in kept if chance(d.text) < toxicity.THRESHOLD]
    assert run(1, kept) == [d.doc_id for d in clean]

    ids = [d.doc_id for d in clean]
    roots = brute_components(ids, [brute_fingerprint(d.text) for d in clean])
    single = [d for d, r in zip(clean, roots, strict=True) if d.doc_id == r]
    single = [d for d in single if d.doc_id not in brute_near_copies([(d.doc_id, d.text) for d in single])]
    assert run(2, clean) == [d.doc_id for d in single]

    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    fresh = [d for d in single if not any(i in d.text for i in items)]
    left = run(3, single)
    assert set(left) == {d.doc_id for d in fresh} and len(fresh) < len(single)

    whole = cp.run(spark, folder).collect()
    encode = tokens.encoder(tokens.default_vocabulary()).encode
    assert {p.doc_id for p in whole} == set(left)
    for d in fresh:
        mine = sorted((p for p in whole if p.doc_id == d.doc_id), key=lambda p: p.start)
        assert sum(p.length for p in mine) == mine[0].doc_tokens == len(encode(d.text)) // tokens.encoder(tokens.default_vocabulary()).width + 1


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert language_id.UNKNOWN == "und"


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, Score string, score double, lang_pred string, fp string, row bigint, doc string, key string"


def test_rows_stand_for_themselves(spark, folder):
    """Ids that repeat or are missing, copies, long texts and clashing columns, through every stage that filters."""
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    base = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(30).collect()]
    base = [t for t in base if item not in t]
    mine = lambda d, t: (d, t, "en", "s", len(t or ""), "own", 7.0, "mine", "f", 5, "d", "k")
    table = [mine(2, base[0]), mine(2, base[1]), mine(None, base[2]), mine(None, base[3]), mine(None, f"x {item} y"), mine(8, f"x {item} y"), mine(9, base[4]), mine(9, base[4]), mine(None, base[4]), mine(10, base[5] * 40), mine(11, None)]
    docs = spark.createDataFrame(table, COLUMNS.replace("Score string", "Other string"))
    lower = spark.createDataFrame([(*t[:5], "own", *t[7:]) for t in table], COLUMNS.replace(", score double", ""))
    stage = dict(cp.STAGES)
    rows = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    has = lambda *keep: sorted((str(t[0]), t[1] or "") for t in (table[i] for i in keep))

    one = stage["SimHash near-dedup"](spark, docs, folder)
    assert rows(one) == has(0, 1, 2, 3, 5, 6, 9, 10)
    assert rows(stage["benchmark decontamination"](spark, docs, folder)) == has(0, 1, 2, 3, 6, 7, 8, 9, 10)
    for name in ("language ID", "toxicity"):
        for df in (docs, lower):
            kept = stage[name](spark, df, folder)
            assert kept.columns == df.columns
            assert {(r[-7] if df is docs else r[5]) for r in kept.collect()} <= {"own"} and kept.count() >= 9
    assert all(r.score == 7.0 and r.lang_pred == "mine" and r.row == 5 for r in stage["language ID"](spark, docs, folder).collect())
    assert one.columns == docs.columns and all(r.row == 5 and r.doc == "d" for r in one.collect())


def test_documents_of_no_language_go(spark, folder):
    """Half one language and half noise, noise alone, and three languages in equal parts."""
    import random

    r = random.Random(1)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    part = {x: " ".join(t.text for t in docs.where(f"lang = '{x}'").orderBy("doc_id").limit(5).collect())[:3000] for x in ("en", "de", "fr")}
    noise = "".join(r.choice("qxzjkvwpyäøþ") for _ in range(3000))
    odd = [(70001, noise), (70002, part["en"]), (70003, part["en"] + part["de"] + part["fr"]), (70004, part["de"][:2500] + part["fr"][:500]), (70005, "qx"), (70006, "")]
    frame = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in odd], docs.schema)
    kept = {r.doc_id for r in cp.identify_language(spark, docs.unionByName(frame), folder).collect()}
    assert kept & {i for i, _ in odd} == {70002, 70004, 70005}
    assert {r.doc_id for r in docs.collect()} <= kept
