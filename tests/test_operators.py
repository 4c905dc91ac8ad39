import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkwell.operators import graph
from sparkwell.operators.chunking import chunks, sections
from sparkwell.operators.embedding import embedding_map, lexical, quantised, signed_hash, valid
from sparkwell.operators.search import fuse, topk


def test_sections_and_chunks(spark):
    text = "  First part.\n\n\n\nSecond   \r\n\r\n \r\n\r\n" + "x" * 850 + " " * 700 + "y"
    docs = spark.createDataFrame([(1, text), (2, None), (3, " \n\n ")], "doc_id bigint, text string")
    parts = sections(docs).orderBy("section_no").collect()
    assert [p.section_id for p in parts] == ["section-1", "section-2", "section-3"]
    assert all(text[p.start_offset : p.start_offset + len(p.text)] == p.text for p in parts)
    got = chunks(sections(docs)).orderBy("section_no", "section_chunk_index").collect()
    assert all(text[c.start_offset : c.end_offset] == c.text for c in got)
    last = [c for c in got if c.section_no == 3]
    assert [c.section_chunk_index for c in last] == list(range(1, len(last) + 1))
    assert {c.chunk_id for c in got} >= {"1:section-1:chunk-1", "1:section-3:chunk-1"}


def test_topk_over_blocks(spark, monkeypatch):
    from sparkwell.operators import search

    monkeypatch.setattr(search, "ROWS", 30)
    monkeypatch.setattr(search, "QUERIES", 4)
    r = np.random.default_rng(0)
    v = [(i, r.standard_normal(8).tolist()) for i in range(200)] + [(500, [0.0] * 8), (3000, None)][:1]
    vectors = spark.createDataFrame(v, "id bigint, v array<double>")
    queries = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    got = {(x.query_id, x.rank): x.id for x in topk(queries, vectors, 4).collect()}
    m = np.array([x for _, x in v])
    n = np.linalg.norm(m, axis=1)
    n[n == 0] = 1
    for i, (q, x) in enumerate(v):
        if q % 20 == 0:
            s = m @ np.array(x) / n / n[i]
            s = np.floor(s * 1e9 + 0.5) / 1e9
            want = sorted(range(len(v)), key=lambda j: (-s[j], v[j][0]))[:4]
            assert [got[q, k + 1] for k in range(4)] == [v[j][0] for j in want]


def test_vectors(spark):
    df = spark.createDataFrame([("boxes box query",), ("",), (None,)], "t string").select(lexical(F.col("t")).alias("v"), "t")
    got = [r.v for r in df.collect()]
    assert abs(math.sqrt(sum(x * x for x in got[0])) - 1) < 1e-9 and max(got[0]) == round(2 / math.sqrt(5), 12)
    assert set(got[1]) == set(got[2]) == {0.0}
    v = F.array(*map(F.lit, (-1.0, 0.5, 0.25)))
    row = spark.range(1).select(quantised(v, 7).alias("q"), valid(v, 3).alias("a"), valid(v, 4).alias("b"), signed_hash(F.lit("boxes of vectors")).alias("s")).first()
    assert row.q.codes == [-7, 4, 2] and row.a and not row.b and len(row.s) == 5
    m = spark.createDataFrame([(i, [float(i), 1.0, float(-i) * 2]) for i in range(5)], "vec_id bigint, embedding array<double>")
    at = {r.vec_id: (r.x, r.y) for r in embedding_map(m).collect()}
    assert at[0] == (92.0, 8.0) and at[4] == (8.0, 92.0)


def test_graph(spark):
    texts = [("c1", "Vector index cache. The vector index!"), ("c2", "vector index and api module"), ("c3", "nothing of it is"), ("c4", "a b " * 5)]
    found = graph.entities(spark.createDataFrame(texts, "chunk_id string, text string"))
    labels = {(r.chunk_id, r.label): r for r in found.collect()}
    assert ("c1", "vector index") in labels and labels["c1", "vector"].confidence == 0.7 and not [k for k in labels if k[0] == "c4"]
    edges = {(r.source, r.target): r for r in graph.edges(found).collect()}
    assert edges["index", "vector"].chunks == 2 and edges["index", "vector"].confidence == 0.6
    q = spark.createDataFrame([(1, "which vector index")], "query_id bigint, question string")
    hits = graph.entity_hits(q, graph.nodes(found))
    assert hits.where("rank = 1").first().label == "vector index"
    steps = graph.steps(hits.where("rank = 1"), graph.edges(found)).collect()
    assert {s.depth for s in steps} == {1, 2} and all(s.source == "vector index" for s in steps if s.depth == 1)


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.9)], "query_id bigint, id string, semantic double")
    b = spark.createDataFrame([(1, "x", 1.0), (1, "z", 0.1)], "query_id bigint, id string, hyde double")
    got = [(r.id, r.final) for r in fuse([a, b]).orderBy("rank").collect()]
    assert got == [("y", 0.405), ("x", 0.375), ("z", 0.015)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert chunks(sections(docs)).count() == 0


def test_topk_carries_columns(spark, monkeypatch):
    from sparkwell.operators import search

    r = random.Random(3)
    vectors = spark.createDataFrame([(f"v{i:03d}", [r.gauss(0, 1) for _ in range(8)], f"text {i}" if i % 9 else None, i) for i in range(300)], "id string, v array<double>, text string, n int").repartition(5)
    queries = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(20)], "query_id int, qv array<double>")
    told = {x.id: (x.text, x.n) for x in vectors.collect()}
    few = sorted(map(tuple, search.topk(queries, vectors, 4, carry=("text", "n")).collect()))
    monkeypatch.setattr(search, "QUERIES", 6)
    many = sorted(map(tuple, search.topk(queries, vectors, 4, carry=("text", "n")).collect()))
    plain = sorted(map(tuple, search.topk(queries, vectors, 4).collect()))
    assert few == many and [(*x[:3], x[5]) for x in few] == plain and all(told[x[1]] == (x[3], x[4]) for x in few)
