from collections import Counter, defaultdict

from sparkwell.operators import graph
from sparkwell.plans import quality, retrieval
from sparkwell.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_edge_against_brute_force(spark, tmp_path):
    """Pairs that meet in one chunk only are edges too, and are walked."""
    for table, n in (("documents", 12), ("benchmark", 4)):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(n).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    rows = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    found = retrieval.found_entities(read)
    hits = graph.entity_hits(retrieval.questions(read), graph.nodes(found)).collect()
    labels, chunks = defaultdict(set), defaultdict(set)
    for r in found.collect():
        labels[r.chunk_id].add(r.label)
        chunks[r.label].add(r.chunk_id)

    met = Counter((a, b) for of in labels.values() for a in of for b in of if a < b)
    sure = {p: round(min(1.0, 0.52 + 0.08 * (n - 1)), 6) for p, n in met.items()}
    assert {(r.source, r.target): (r.chunks, r.confidence) for r in rows("graph_edges")} == {p: (n, sure[p]) for p, n in met.items()}
    assert 1 in met.values()

    ways = defaultdict(dict)
    for (a, b), c in sure.items():
        ways[a][b] = ways[b][a] = c
    first = {(h.query_id, h.label, b, 1, c) for h in hits for b, c in ways[h.label].items()}
    front = {(q, b) for q, _, b, _, _ in first} - {(h.query_id, h.label) for h in hits}
    steps = first | {(q, a, b, 2, c) for q, a in front for b, c in ways[a].items()}
    got = rows("graph_bfs_steps")
    assert first and {(r.query_id, r.source, r.target, r.depth, r.confidence) for r in got} == steps and len(got) == len(steps)

    score = Counter()
    for h in hits:
        for k in chunks[h.label]:
            score[h.query_id, k] += 0.8 * h.score
    for q, _, b, d, c in steps:  # every step counts, not only the best one to an entity
        for k in chunks[b]:
            score[q, k] += round(1 / (d + 1), 6) * c
    ranked = defaultdict(list)
    for (q, _), s in score.items():
        ranked[q].append(s)
    got = {(r.query_id, r["rank"]): r for r in rows("graph_retrieve")}
    want = {(q, k + 1): s for q, of in ranked.items() for k, s in enumerate(sorted(of, reverse=True)[:5])}
    assert got.keys() == want.keys() and all(abs(got[k].score - s) < 2e-6 for k, s in want.items())
    assert all(abs(r.score - score[r.query_id, r.chunk_id]) < 2e-6 for r in got.values())
    reached = defaultdict(set)
    for h in hits:
        reached[h.query_id].add(h.label)
    for q, _, b, _, _ in steps:
        reached[q].add(b)
    assert all(r.labels == "|".join(sorted(labels[r.chunk_id] & reached[r.query_id])) for r in got.values())


def test_expected_documents_hold_the_whole_item(spark, tmp_path):
    items = [(1, "One two three, four five six seven eight nine ten"), (2, "three FOUR five"), (3, "..."), (4, None)]
    docs = [(1, "x one two three four five six seven eight nine ten y"), (2, "one two three four five six seven eight nine then ten"), (3, "three four"), (4, "three, four\nfive"), (5, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = quality.expected(lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(1, 1), (2, 1), (2, 2), (2, 4)} and len(found) == 4


def test_best_chunks_are_those_of_the_whole_join(spark, tmp_path):
    """Scores, labels and ranks as if all reached entities met all their chunks, while few lines are scored whole."""
    import random

    r = random.Random(3)
    names = [f"entity{i}" for i in range(300)]
    found = {f"c{i}": r.sample(names[: 20 if i % 3 else 300], r.randint(1, graph.MOST)) for i in range(3000)}
    rows = spark.createDataFrame([(c, x) for c, of in found.items() for x in of], "chunk_id string, label string")
    hits = spark.createDataFrame([(q, names[7 * q + j], 0.5 + j / 10) for q in range(4) for j in range(3)] + [(9, "nowhere", 1.0), (8, "entity299", 0.3)], "query_id bigint, label string, score double")
    walked = [(q, "x", x, r.choice([1, 2]), round(r.random() ** 6 + 0.1, 6)) for q in range(4) for x in names for _ in range(r.randint(0, 3))]
    steps = spark.createDataFrame(walked, "query_id bigint, source string, target string, depth int, confidence double")
    got = graph.chunk_scores(hits, steps, rows, 5).collect()
    part = defaultdict(float)
    for h in hits.collect():
        part[h.query_id, h.label] += 0.8 * h.score
    for q, _, x, d, c in walked:
        part[q, x] += round(1 / (d + 1), 6) * c
    for q in (0, 1, 2, 3, 8):
        scores = {c: sum(part.get((q, x), 0) for x in of) for c, of in found.items() if any((q, x) in part for x in of)}
        want = sorted(scores.values(), reverse=True)[:5]
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])
        assert len(mine) == len(want) and all(abs(x.score - s) < 2e-6 and abs(scores[x.chunk_id] - s) < 2e-6 for x, s in zip(mine, want, strict=True))
        assert all(x.labels == sorted(y for y in found[x.chunk_id] if (q, y) in part) for x in mine)
    assert {x.query_id for x in got} == {0, 1, 2, 3, 8}
    # The step from entities to chunks is written: it holds a part of what all entities would give.
    import glob
    whole = sum((q, x) in part for q in range(4) for of in found.values() for x in of)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert min(spark.read.parquet(f).count() for f in glob.glob(f"{folder}/lines-*")) < whole / 4


def test_graph_is_read_once_and_edges_turned_without_a_second_count(spark):
    """Edges in both directions come of one count of the pairs, and walks read what was written."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(QUERIES["strongest_edges"](spark, FOLDER)).count("regexp_extract_all") <= plan(QUERIES["graph_edges"](spark, FOLDER)).count("regexp_extract_all")
    assert "regexp_extract_all" not in plan(QUERIES["graph_bfs_steps"](spark, FOLDER))
    assert "regexp_extract_all" not in plan(QUERIES["graph_strongest_steps"](spark, FOLDER))


def test_documents_are_not_shuffled_to_meet_items(spark):
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    found = quality.expected(read)
    assert found.inputFiles() and "documents" not in "".join(found.inputFiles())  # written once, however often it is read
