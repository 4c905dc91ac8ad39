"""A graph store merged batch by batch, aliases, and strategies to walk it."""

from pyspark.sql import functions as F

from sparkwell.operators import graph, graph_store as gs
from sparkwell.operators.components import components

TEXTS = [
    ("c1", "The retrieval modules call the vector index and its provider."), ("c2", "A module caches retrieval results; the vector index is hybrid."), ("c3", "Providers of embeddings register modules."),
    ("c4", "Semantic chunking splits documents into sections."), ("c5", "The vector index and the provider again."), ("c6", ""),
]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("z", "y"), ("loop", "loop"), (None, "q"), ("hub", "x")] + [("hub", f"h{i}") for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"} and got["loop"] == "loop" and "q" not in got
    assert {got[k] for k in ("x", "y", "z", "hub", *(f"h{i}" for i in range(30)))} == {"h0"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_merging_equals_building(spark, tmp_path):
    chunks = spark.createDataFrame(TEXTS, "chunk_id string, text string")
    store = gs.GraphStore(spark, str(tmp_path))
    store.merge(chunks.where("chunk_id <= 'c3'"), "one")
    store.merge(chunks.where("chunk_id >= 'c3'"), "two")  # c3 again: it counts once
    for _ in range(2):
        store.merge(chunks.where("chunk_id >= 'c3'"), "two")  # the same batch again
    found = graph.entities(chunks)
    columns = ("label", "type", "confidence", "chunks")
    assert rows(store.nodes(), *columns) == rows(graph.nodes(found), *columns)
    columns = ("source", "target", "type", "chunks", "confidence")
    assert rows(store.edges(), *columns) == rows(graph.edges(found), *columns)
    one = store.nodes(["vector index"])
    assert rows(one, "label", "chunks") == [("vector index", 3)]
    assert "PartitionFilters: [" in (plan := one._jdf.queryExecution().toString()) and "bucket#" in plan
    before = rows(store.nodes(), "label", "chunks", "aliases"), rows(store.edges(), *columns)
    store.compact()
    assert (rows(store.nodes(), "label", "chunks", "aliases"), rows(store.edges(), *columns)) == before
    store.merge(spark.createDataFrame([("c9", "vector index")], "chunk_id string, text string"), "three")
    assert rows(store.nodes(["vector index"]), "label", "chunks") == [("vector index", 4)]


def test_entities_meet_through_aliases(spark, tmp_path):
    store = gs.GraphStore(spark, str(tmp_path))
    store.merge(spark.createDataFrame(TEXTS, "chunk_id string, text string"), "one")
    of = {r.label: r.entity for r in store.entities().collect()}
    assert of["providers"] == of["provider"] == "provider" and of["vector"] != of["index"]
    named = [("ibm", ["big blue"]), ("international business machines", ["big blue", "i b m"]), ("i b m corp", ["i b m"]), ("apple", []), ("pear", None), ("fruit", ["apple"])]
    got = {r.label: r.entity for r in gs.resolved(spark.createDataFrame(named, "label string, aliases array<string>")).collect()}
    assert {got[k] for k in ("ibm", "international business machines", "i b m corp")} == {"i b m corp"} and got["pear"] == "pear" and got["fruit"] == got["apple"] == "apple"


def test_extractors_are_exchangeable(spark, tmp_path):
    def acronyms(chunks):
        found = chunks.select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z]{2,}\b"), 0)).alias("label"))
        return found.select("chunk_id", "label", F.lit("acronym").alias("type"), F.lit(0.9).alias("confidence"), F.lit(0).alias("pos"))

    store = gs.GraphStore(spark, str(tmp_path), [gs.with_stems, acronyms])
    store.merge(spark.createDataFrame([("c1", "The API of the retrieval module"), ("c2", "An api")], "chunk_id string, text string"), "one")
    assert rows(store.nodes(["api"]), "label", "type", "confidence", "chunks") == [("api", "acronym", 0.9, 2)]


def test_strategies(spark, tmp_path):
    links = [("a", "b", 0.9), ("a", "c", 0.6), ("a", "d", 0.5), ("b", "e", 0.5), ("c", "e", 1.0), ("c", "f", 0.9), ("b", "a", 0.9), ("d", "g", 1.0)]
    hits, edges = spark.createDataFrame([(1, "a"), (2, "none")], "query_id int, label string"), spark.createDataFrame(links, "source string, target string, confidence double")
    got = rows(gs.strongest(2)(hits, edges), "query_id", "source", "target", "depth")
    assert got == [(1, "a", "b", 1), (1, "a", "c", 1), (1, "c", "e", 2), (1, "c", "f", 2)]
    wide = rows(gs.strongest(100)(hits, edges), "target")
    assert wide == sorted({(t,) for t in rows(graph.steps(hits, edges), "target") for t in t if t != "a"})
    store = gs.GraphStore(spark, str(tmp_path))
    store.merge(spark.createDataFrame(TEXTS, "chunk_id string, text string"), "one")
    start = spark.createDataFrame([(1, "vector index")], "query_id int, label string")
    assert store.traverse(start).count() > store.traverse(start, gs.strongest(2)).count() == 4


def test_only_shared_aliases_go_to_the_rounds(spark, monkeypatch):
    given = []
    find = gs.components
    monkeypatch.setattr(gs, "components", lambda edges: (given.append(edges.count()), find(edges))[1])
    named = spark.createDataFrame([("alone", ["x"]), ("one", ["y"]), ("two", ["y", "z"]), ("none", []), ("three", ["alone two"]), ("alone two", ["w"])], "label string, aliases array<string>")
    got = {(r.label, r.entity) for r in gs.resolved(named).collect()}
    assert got == {("alone", "alone"), ("one", "one"), ("two", "one"), ("none", "none"), ("three", "alone two"), ("alone two", "alone two")} and given == [3]
