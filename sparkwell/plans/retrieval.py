"""Queries from documents to cited results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import understand
from ..functions.text import trimmed
from ..operators import graph, graph_store
from ..operators.chunking import chunks, sections
from ..operators.embedding import embedding_map, lexical, quantised, valid, variance, widest_dimensions
from ..operators.search import fuse, hybrid, rerank, topk
from ..session import written
from .registry import query

B = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
STEM = "CASE WHEN length(w) > 4 AND suffix(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND suffix(w, 'es') THEN left(w, length(w) - 2) WHEN length(w) > 3 AND suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END"
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
HASH = "list_reduce(list_transform(string_split(w, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT))"

CHUNKS = f"""
parts AS (SELECT doc_id, trim(text, {B}) AS t, length(text) - length(ltrim(text, {B})) AS base FROM documents WHERE trim(text, {B}) <> ''),
slices AS (SELECT doc_id, base, t, unnest(generate_series(0, CAST(ceil(greatest(length(t) - 800, 0) / 700.0) * 700 AS BIGINT), 700)) AS s FROM parts),
cuts AS (SELECT doc_id, base, s, substring(t, s + 1, 800) AS x FROM slices),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n FROM cuts WHERE trim(x, {B}) <> ''),
chunks AS (SELECT doc_id || ':section-1:chunk-' || n AS chunk_id, doc_id, n, trim(x, {B}) AS text, base + s + length(x) - length(ltrim(x, {B})) AS start_offset FROM kept)"""


def buckets(source: str, key: str, text: str) -> str:
    return f"""SELECT {key}, {HASH} % 64 AS bucket, count(*) AS c FROM (
      SELECT {key}, {STEM} AS w FROM (SELECT {key}, unnest({WORDS.format(text)}) AS w FROM {source})) GROUP BY ALL"""


DENSE = f"""{CHUNKS},
cb AS ({buckets('chunks', 'chunk_id', 'text')}), qb AS ({buckets('benchmark', 'item_id', 'text')}),
cn AS (SELECT chunk_id, sqrt(sum(c * c)) AS n FROM cb GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM qb GROUP BY 1),
dots AS (SELECT item_id, chunk_id, sum(qb.c * cb.c) AS d FROM qb JOIN cb USING (bucket) GROUP BY 1, 2),
scored AS (SELECT q.item_id AS query_id, c.chunk_id, coalesce(floor(d / (qn.n * cn.n) * 1e6 + 0.5) / 1e6, 0) AS score
  FROM benchmark q CROSS JOIN chunks c LEFT JOIN dots ON dots.item_id = q.item_id AND dots.chunk_id = c.chunk_id LEFT JOIN qn ON qn.item_id = q.item_id LEFT JOIN cn ON cn.chunk_id = c.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""


def all_chunks(read):
    return chunks(sections(read("documents")))


def questions(read):
    return read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def dense(read, k: int):
    """(query_id, id, score, rank) of each benchmark item's k nearest chunks by lexical vectors."""
    vectors = all_chunks(read).select(F.col("chunk_id").alias("id"), lexical(F.col("text")).alias("v"))
    return topk(questions(read).select("query_id", lexical(F.col("question")).alias("qv")), vectors, k, digits=6)


def candidates(read, k: int):
    """The nearest chunks with their texts and questions; chunks are made once, their texts come along with the vectors."""
    carried = ("doc_id", "section_id", "text")
    vectors = all_chunks(read).select(F.col("chunk_id").alias("id"), lexical(F.col("text")).alias("v"), *carried)
    near = topk(questions(read).select("query_id", lexical(F.col("question")).alias("qv")), vectors, k, digits=6, carry=carried)
    return near.join(questions(read), "query_id")


#: The nearest other question of each: what a cache of answered questions would offer.
NEAR_QUESTION = """nq AS (SELECT a.item_id AS query_id, b.item_id AS cached, floor(sum(a.c * b.c) / (max(x.n) * max(y.n)) * 1e6 + 0.5) / 1e6 AS similarity FROM qb a JOIN qb b ON a.bucket = b.bucket AND a.item_id <> b.item_id JOIN qn x ON x.item_id = a.item_id JOIN qn y ON y.item_id = b.item_id GROUP BY 1, 2),
nearest AS (SELECT * FROM nq QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cached) = 1),
five AS (SELECT query_id, list(chunk_id ORDER BY rank) AS ids FROM ranked WHERE rank <= 5 GROUP BY 1),
shadow AS (SELECT n.query_id, n.cached, similarity, floor(len(list_intersect(f.ids, c.ids)) / greatest(1, len(f.ids))::DOUBLE * 1e3 + 0.5) / 1e3 AS overlap FROM nearest n JOIN five f ON f.query_id = n.query_id JOIN five c ON c.query_id = n.cached)"""


def near_question(read):
    """(query_id, cached, similarity): each question's nearest other one."""
    q = questions(read).select("query_id", lexical(F.col("question")).alias("qv"))
    two = topk(q, q.select(F.col("query_id").alias("id"), F.col("qv").alias("v")), 2, digits=6).where("id <> query_id")
    best = F.min_by(F.struct(F.col("id").alias("cached"), F.col("score").alias("similarity")), "rank").alias("b")
    return two.where("score > 0").groupBy("query_id").agg(best).select("query_id", "b.*")


def shadow(read):
    """(query_id, cached, similarity, overlap): how much of a question's own five results those of the nearest other one have."""
    five = dense(read, 5).groupBy("query_id").agg(F.collect_set("id").alias("ids"))  # five
    met = near_question(read).join(five, "query_id").join(five.select(F.col("query_id").alias("cached"), F.col("ids").alias("old")), "cached")
    return met.select("query_id", "cached", "similarity", tx.rounded(F.size(F.array_intersect("ids", "old")) / F.greatest(F.lit(1), F.size("ids")), 3).alias("overlap"))


@query(f"WITH {CHUNKS} SELECT chunk_id, doc_id, n AS section_chunk_index, md5(text) AS text_md5, start_offset, start_offset + length(text) AS end_offset FROM chunks")
def chunk_documents(read):
    return all_chunks(read).select("chunk_id", "doc_id", "section_chunk_index", F.md5("text").alias("text_md5"), "start_offset", "end_offset")


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, max(start_offset + length(text)) AS end_offset FROM chunks GROUP BY 1")
def chunk_stats(read):
    return all_chunks(read).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max("end_offset").alias("end_offset"))


@query(f"SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents) GROUP BY 1")
def tokenize_terms(read):
    terms = read("documents").select("doc_id", F.explode(tx.words("text")).alias("word"))
    return terms.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT stem, count(*) AS n FROM (SELECT {STEM} AS stem FROM (SELECT unnest({WORDS.format('text')}) AS w FROM documents)) GROUP BY 1")
def stem_terms(read):
    return read("documents").select(F.explode(tx.stems("text")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query(f"SELECT w AS word, {HASH} AS hash FROM (SELECT DISTINCT unnest({WORDS.format('text')}) AS w FROM benchmark)")
def hash_terms(read):
    words = read("benchmark").select(F.explode(tx.words("text")).alias("word")).distinct()
    return words.select("word", tx.hash31(F.col("word")).alias("hash"))


@query("""SELECT item_id, len(list_distinct(list_transform(generate_series(1, length(f) - 2), lambda i: substring(f, i, 3)))) AS trigrams
FROM (SELECT item_id, list_aggregate(regexp_extract_all(lower(text), '[a-z0-9]+'), 'string_agg', '') AS f FROM benchmark)""")
def trigram_counts(read):
    return read("benchmark").select("item_id", F.size(tx.trigrams("text")).cast("bigint").alias("trigrams"))


@query(f"WITH {CHUNKS}, cb AS ({buckets('chunks', 'chunk_id', 'text')}) SELECT c.chunk_id, coalesce(max(b.top), 0) AS top, coalesce(max(b.used), 0) AS used FROM chunks c LEFT JOIN (SELECT chunk_id, floor(max(c) / sqrt(sum(c * c)) * 1e6 + 0.5) / 1e6 AS top, count(*) AS used FROM cb GROUP BY 1) b USING (chunk_id) GROUP BY 1")
def embed_lexical_norms(read):
    vectors = all_chunks(read).select("chunk_id", lexical(F.col("text")).alias("v"))
    return vectors.select("chunk_id", tx.rounded(F.array_max("v"), 6).alias("top"), F.size(F.filter("v", lambda x: x > 0)).cast("bigint").alias("used"))


@query(f"WITH {DENSE} SELECT query_id, chunk_id AS id, score, rank FROM ranked WHERE rank <= 5")
def knn_topk(read):
    return dense(read, 5)


VECTOR_SCORES = """scored AS (SELECT q.vec_id AS query_id, v.vec_id AS id, floor(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""


def vectors_of(read):
    return read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query(f"WITH {VECTOR_SCORES} SELECT * FROM ranked WHERE rank <= 10")
def knn_vectors(read):
    v = vectors_of(read)
    return topk(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv")), v.select("id", "v"), 10, digits=6)


@query(f"WITH {VECTOR_SCORES.replace('WHERE q.vec_id', 'WHERE v.label IN (1, 3) AND q.vec_id')} SELECT * FROM ranked WHERE rank <= 5")
def knn_filtered(read):
    v = vectors_of(read)
    kept = v.where((F.col("label").eqNullSafe(1)) | (F.col("label").eqNullSafe(3)))
    return topk(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv")), kept.select("id", "v"), 5, digits=6)


@query("""SELECT vec_id, floor(s * 1e9 + 0.5) / 1e9 AS scale, CAST(list_sum(list_transform(e, lambda x: CAST(round_even(x / s, 0) AS BIGINT))) AS BIGINT) AS total,
  CAST(list_sum(list_transform(e, lambda x: abs(CAST(round_even(x / s, 0) AS BIGINT)))) AS BIGINT) AS size
FROM (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / 127 AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def quantise_int8(read):
    q = vectors_of(read).select(F.col("id").alias("vec_id"), quantised(F.col("v"), 127).alias("q"))
    add = lambda f: F.aggregate(F.transform("q.codes", f), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return q.select("vec_id", tx.rounded(F.col("q.scale"), 9).alias("scale"), add(lambda x: x.cast("bigint")).alias("total"), add(lambda x: F.abs(x).cast("bigint")).alias("size"))


CODES = """codes AS (SELECT vec_id, list_transform(e, lambda x: CAST(round_even(x / s, 0) AS DOUBLE)) AS q FROM (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / {0} AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))),
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS id, floor(list_cosine_similarity(a.q, b.q) * 1e6 + 0.5) / 1e6 AS score FROM codes a CROSS JOIN codes b WHERE a.vec_id % 50 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 5"""


@query(f"WITH {CODES.format(127)}")
def knn_int8(read):
    q = vectors_of(read).select("id", quantised(F.col("v"), 127)["codes"].cast("array<double>").alias("v"))
    return topk(q.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv")), q, 5, digits=6)


@query(f"WITH {CODES.format(7)}")
def knn_int4(read):
    q = vectors_of(read).select("id", quantised(F.col("v"), 7)["codes"].cast("array<double>").alias("v"))
    return topk(q.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv")), q, 5, digits=6)


@query("SELECT vec_id, len(embedding) = 64 AS valid, floor(list_var_pop(CAST(embedding AS DOUBLE[])) * 1e4 + 0.5) / 1e4 AS variance FROM embeddings")
def vector_variance(read):
    v = F.col("v")
    return vectors_of(read).select(F.col("id").alias("vec_id"), valid(v, 64).alias("valid"), variance(v).alias("variance"))


@query("""WITH x AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings),
v AS (SELECT dim, var_pop(x) AS v FROM x GROUP BY 1) SELECT dim, floor(v * 1e6 + 0.5) / 1e6 AS variance, row_number() OVER (ORDER BY floor(v * 1e9 + 0.5) DESC, dim) AS rank FROM v QUALIFY rank <= 2""")
def widest_dims(read):
    return widest_dimensions(read("embeddings")).select("dim", tx.rounded(F.col("variance"), 6).alias("variance"), "rank")


MAP_SQL = """WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings),
v AS (SELECT dim, row_number() OVER (ORDER BY floor(var_pop(x) * 1e9 + 0.5) DESC, dim) AS r FROM x GROUP BY 1),
a AS (SELECT vec_id, max(CASE WHEN r = 1 THEN x END) AS x, max(CASE WHEN r = 2 THEN x END) AS y FROM x JOIN v USING (dim) WHERE r <= 2 GROUP BY 1),
b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM a),
m AS (SELECT vec_id, CASE WHEN hx > lx THEN floor((8 + (x - lx) / (hx - lx) * 84) * 100 + 0.5) / 100 ELSE 50 END AS x, CASE WHEN hy > ly THEN floor((8 + (y - ly) / (hy - ly) * 84) * 100 + 0.5) / 100 ELSE 50 END AS y FROM a CROSS JOIN b)"""


@query(f"{MAP_SQL} SELECT * FROM m")
def vector_map(read):
    return embedding_map(read("embeddings"))


def hybrid_rows(read):
    return hybrid(candidates(read, 20)).where("hybrid_rank <= 5")


TRI = """(SELECT {k}, list_distinct(list_transform(generate_series(1, length(f) - 2), lambda i: substring(f, i, 3))) AS g FROM (SELECT {k}, list_aggregate(regexp_extract_all(lower({t}), '[a-z0-9]+'), 'string_agg', '') AS f FROM {s}))"""
HYBRID = f"""{DENSE},
near AS (SELECT r.*, q.text AS question, c.text FROM ranked r JOIN benchmark q ON q.item_id = r.query_id JOIN chunks c USING (chunk_id) WHERE rank <= 20),
sparse AS (SELECT n.query_id, n.chunk_id, n.rank, n.score, n.text, floor(len(list_intersect(a.g, b.g)) / sqrt(len(a.g) * len(b.g)) * 1e9 + 0.5) / 1e9 AS sparse
  FROM near n JOIN {TRI.format(k='item_id', t='text', s='benchmark')} a ON a.item_id = n.query_id JOIN {TRI.format(k='chunk_id', t='text', s='chunks')} b USING (chunk_id)),
mixed AS (SELECT *, floor((0.65 * score + (1 - 0.65) * sparse) * 1e9 + 0.5) / 1e9 AS combined FROM sparse),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, length(text) DESC, chunk_id) AS hybrid_rank FROM mixed)"""


@query(f"WITH {HYBRID} SELECT query_id, chunk_id AS id, score, sparse, combined, hybrid_rank FROM h WHERE hybrid_rank <= 5")
def hybrid_topk(read):
    return hybrid_rows(read).select("query_id", "id", "score", "sparse", "combined", "hybrid_rank")


STEMSET = "list_distinct(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: " + STEM + "))"


@query(f"""WITH {DENSE}, near AS (SELECT r.*, {STEMSET.format('q.text')} AS a, {STEMSET.format('c.text')} AS b FROM ranked r JOIN benchmark q ON q.item_id = r.query_id JOIN chunks c USING (chunk_id) WHERE rank <= 15),
o AS (SELECT *, coalesce(floor(len(list_intersect(a, b)) / nullif(sqrt(len(a) * len(b)), 0) * 1e9 + 0.5) / 1e9, 0) AS overlap FROM near),
s AS (SELECT *, floor((0.8 * score + 0.2 * overlap) * 1e9 + 0.5) / 1e9 AS rerank_score FROM o)
SELECT query_id, chunk_id AS id, rank, overlap, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS after_rank FROM s""")
def rerank_topk(read):
    return rerank(candidates(read, 15)).select("query_id", "id", "rank", "overlap", "rerank_score", "after_rank")


def entity_labels(read):
    """(chunk_id, labels) of all chunks, written: what reads them often does not make chunks again."""
    return written(graph.labels(all_chunks(read)), "labels")


def found_entities(read):
    return graph.entities(all_chunks(read))


def entity_graph(read, asked):
    """(entities, hits of ``asked``, edges): each made once and written, since walks and scores read them often."""
    labelled = entity_labels(read)
    found = graph.listed(labelled)
    hits = written(graph.entity_hits(asked, graph.nodes(found)), "hits")
    return found, hits, written(graph.meetings(labelled), "edges")


EVERY_ENTITY = f"""{CHUNKS},
toks AS (SELECT chunk_id, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT chunk_id, {WORDS.format('text')} AS w FROM chunks)),
t AS (SELECT chunk_id, i, w[i] AS a, w[i + 1] AS b FROM toks),
e AS (SELECT chunk_id, i, 0 AS k, a AS label, CASE WHEN a IN {tuple(graph.PRIORITY)} THEN 0.7 ELSE 0.55 END AS confidence FROM t WHERE a NOT IN {tuple(graph.STOPWORDS)} AND length(a) > 2 AND (length(a) >= 6 OR a IN {tuple(graph.PRIORITY)})
  UNION ALL SELECT chunk_id, i, 1, a || ' ' || b, 0.8 FROM t WHERE a NOT IN {tuple(graph.STOPWORDS)} AND length(a) > 2 AND b IS NOT NULL AND b NOT IN {tuple(graph.STOPWORDS)} AND length(b) > 2),
f AS (SELECT chunk_id, label, min(i * 2 + k) AS met, max(confidence) AS confidence FROM e GROUP BY 1, 2)"""
ENTITIES = f"""{EVERY_ENTITY},
g AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY met) AS r FROM f QUALIFY r <= 12)"""
EDGES = f"""{ENTITIES}, pairs AS (SELECT x.label AS source, y.label AS target, count(*) AS chunks FROM g x JOIN g y ON x.chunk_id = y.chunk_id AND x.label < y.label GROUP BY 1, 2)"""


TYPE = """CASE WHEN contains({0}, 'api') THEN 'api' WHEN contains({0}, 'module') THEN 'module' WHEN contains({0}, 'dependency') THEN 'dependency' WHEN contains({0}, 'file') THEN 'file' WHEN contains({0}, 'event') THEN 'event' WHEN contains({0}, 'cache') OR contains({0}, 'retrieval') THEN 'concept' ELSE 'technology' END"""
RELATION = "CASE WHEN contains(source, 'dependency') OR contains(target, 'dependency') THEN 'depends_on' WHEN contains(source, 'api') OR contains(target, 'api') THEN 'references' ELSE 'co_occurs_with' END"


@query(f"WITH {ENTITIES} SELECT label, {TYPE.format('label')} AS type, max(CAST(confidence AS DOUBLE)) AS confidence, count(DISTINCT chunk_id) AS chunks FROM g GROUP BY 1")
def graph_nodes(read):
    return graph.nodes(found_entities(read)).select("label", "type", "confidence", "chunks")


@query(f"""WITH {EVERY_ENTITY}, pairs AS (SELECT x.label AS source, y.label AS target, count(*) AS chunks FROM f x JOIN f y ON x.chunk_id = y.chunk_id AND x.label < y.label GROUP BY 1, 2)
SELECT source, target, {RELATION} AS type, chunks, CAST(floor(least(1.0, 0.52 + 0.08 * (chunks - 1)) * 1e6 + 0.5) / 1e6 AS DOUBLE) AS confidence FROM pairs""")
def graph_edges(read):
    """All pairs of entities that meet in a chunk, whatever their number; walks look at the first twelve of each chunk."""
    return graph.meetings(graph.labels(all_chunks(read), None)).select("source", "target", "type", "chunks", "confidence")


STEPS = f"""{EDGES}, lw AS (SELECT DISTINCT label, unnest(string_split(label, ' ')) AS word FROM g), ln AS (SELECT label, count(*) AS nl FROM lw GROUP BY 1),
qw AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format('text')}) AS word FROM benchmark), qn AS (SELECT query_id, count(*) AS nq FROM qw GROUP BY 1),
es AS (SELECT query_id, label, floor(count(*) / sqrt(max(nq) * max(nl)) * 1e6 + 0.5) / 1e6 AS score FROM qw JOIN lw USING (word) JOIN qn USING (query_id) JOIN ln USING (label) GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS hit_rank FROM es QUALIFY hit_rank <= 5),
links AS (SELECT source AS a, target AS b, floor(least(1.0, 0.52 + 0.08 * (chunks - 1))::DOUBLE * 1e6 + 0.5) / 1e6 AS confidence FROM pairs), ways AS (SELECT a, b, confidence FROM links UNION ALL SELECT b, a, confidence FROM links),
one AS (SELECT query_id, a AS source, b AS target, CAST(1 AS BIGINT) AS depth, confidence FROM hits JOIN ways ON a = label),
front AS (SELECT DISTINCT query_id, target FROM one WHERE (query_id, target) NOT IN (SELECT (query_id, label) FROM hits)),
steps AS (SELECT * FROM one UNION ALL SELECT query_id, a, b, 2, confidence FROM front JOIN ways ON a = target)"""


@query(f"WITH {STEPS} SELECT * FROM steps")
def graph_bfs_steps(read):
    _, hits, links = entity_graph(read, questions(read))
    return graph.steps(hits, links)


STEMMED = f"array_to_string(list_transform(string_split(label, ' '), lambda w: {STEM}), ' ')"


@query(f"""WITH {ENTITIES}, n AS (SELECT chunk_id, label, confidence, {STEMMED} AS alias FROM g)
SELECT min(label) AS entity, alias, count(DISTINCT label) AS labels, count(DISTINCT chunk_id) AS chunks, max(CAST(confidence AS DOUBLE)) AS confidence FROM n GROUP BY alias HAVING count(DISTINCT label) > 1""")
def graph_aliases(read):
    """Entities of several labels that share an alias, here their singular."""
    found = written(graph_store.mentions(all_chunks(read), [lambda c: graph.entities(c).withColumn("aliases", graph_store.stem_alias(F.col("label")))]), "mentions")
    alias = F.concat(F.lit("the "), F.col("aliases")[0])  # no label begins so: a label is not taken for another's alias
    named = found.groupBy("label").agg(F.first(F.array(alias)).alias("aliases"))
    entities = written(graph_store.resolved(named), "entities")
    several = written(entities.join(entities.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity"), "entity"), "several")
    rows = found.join(several, "label")
    merged = rows.groupBy("entity").agg(
        F.first(F.col("aliases")[0]).alias("alias"), F.countDistinct("label").alias("labels"), F.countDistinct("chunk_id").alias("chunks"), F.max("confidence").alias("confidence")
    )
    return merged.where("labels > 1")


@query(f"""WITH {STEPS}, w1 AS (SELECT query_id, a AS source, b AS target, confidence, confidence AS way FROM hits JOIN ways ON a = label WHERE (query_id, b) NOT IN (SELECT (query_id, label) FROM hits)),
b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY way DESC, source) AS n FROM w1 QUALIFY n = 1), s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY way DESC, target) AS m FROM b1 QUALIFY m <= 3),
w2 AS (SELECT s1.query_id, a AS source, b AS target, ways.confidence, s1.way * ways.confidence AS way FROM s1 JOIN ways ON a = target WHERE (s1.query_id, b) NOT IN (SELECT (query_id, label) FROM hits) AND (s1.query_id, b) NOT IN (SELECT (query_id, target) FROM s1)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY way DESC, source) AS n FROM w2 QUALIFY n = 1), s2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY way DESC, target) AS m FROM b2 QUALIFY m <= 3)
SELECT query_id, source, target, CAST(1 AS BIGINT) AS depth, confidence FROM s1 UNION ALL SELECT query_id, source, target, 2, confidence FROM s2""")
def graph_strongest_steps(read):
    """Walks from the questions' entities along the strongest ways, three new targets at each depth."""
    _, hits, links = entity_graph(read, questions(read))
    return graph_store.strongest(3)(hits, links)


def graph_signals(read, k: int, of=None):
    """``graph.chunk_scores`` of the benchmark's questions, or of those in ``of``; entities and chunks are numbers until the best chunks are known."""
    labelled, names = graph.keyed(graph.labels(all_chunks(read)))
    hits = graph.entity_hits(questions(read) if of is None else of, names).join(names, "label")
    hits = written(hits.select("query_id", F.col("key").alias("label"), "score"), "hits")
    ways = written(graph.near_ways(hits, labelled.select(F.col("keys").alias("labels"))), "ways")
    found = labelled.select(F.explode("keys").alias("label"), F.col("number").alias("chunk_id"))
    scored = graph.open_scores(hits, graph.walk(hits, ways), found, k).withColumnsRenamed({"chunk_id": "number", "labels": "reached"})
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    best = written(scored.withColumn("place", F.rank().over(order)).where(F.col("place") <= k), "best")  # with all that tie with the last
    named = best.join(labelled, "number").withColumn("labels", F.filter(F.arrays_zip("labels", "keys"), lambda x: F.array_contains("reached", x["keys"]))["labels"])
    rows = named.select("query_id", "chunk_id", "score", "depth", "edge", "proximity", F.sort_array("labels").alias("labels"))
    return rows.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)


GRAPH = f"""{STEPS}, near AS (SELECT query_id, target AS label, sum(floor(1.0::DOUBLE / (depth + 1) * 1e6 + 0.5) / 1e6 * confidence) AS part, min(depth) AS depth, max(confidence) AS edge, max(floor(1.0::DOUBLE / (depth + 1) * 1e6 + 0.5) / 1e6) AS proximity FROM steps GROUP BY 1, 2),
parts2 AS (SELECT query_id, chunk_id, label, 0.8::DOUBLE * score AS part, 0 AS depth, 0.0::DOUBLE AS edge, 1.0::DOUBLE AS proximity FROM hits JOIN g USING (label) UNION ALL SELECT query_id, chunk_id, label, part, depth, edge, proximity FROM near n JOIN g USING (label)),
total AS (SELECT query_id, chunk_id, floor(sum(part) * 1e6 + 0.5) / 1e6 AS score, CAST(min(depth) AS BIGINT) AS depth, max(edge) AS edge, max(proximity) AS proximity, array_to_string(list_sort(list(DISTINCT label)), '|') AS labels FROM parts2 GROUP BY 1, 2),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM total)"""


@query(f"WITH {GRAPH} SELECT * FROM gr WHERE rank <= 5")
def graph_retrieve(read):
    """Chunks of the entities that a question hits or that edges reach from there, with what reached them."""
    return graph_signals(read, 5).withColumn("labels", F.array_join("labels", "|"))


FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
SUM = "CASE WHEN length({0}) > {1} THEN trim(left({0}, {1} - 1)) || '…' ELSE {0} END"


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id, {FLAT.format("string_agg(text, ' ' ORDER BY n)")} AS t FROM chunks GROUP BY 1)
SELECT doc_id || ':section-1' AS node_id, CAST(1 AS BIGINT) AS level, CAST(doc_id AS VARCHAR) AS parent_id, md5({SUM.format('t', 180)}) AS summary FROM s
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, NULL, md5({SUM.format('t', 180)}) FROM s
UNION ALL SELECT chunk_id, 2, doc_id || ':section-1', md5({SUM.format('t', 120)}) FROM (SELECT *, {FLAT.format('text')} AS t FROM chunks)""")
def raptor_tree(read):
    return graph.section_tree(all_chunks(read)).select("node_id", "level", "parent_id", F.md5("summary").alias("summary"))


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id, {FLAT.format("string_agg(text, ' ' ORDER BY n)")} AS t FROM chunks GROUP BY 1),
m AS (SELECT doc_id || ':section-1' AS node_id, list_distinct({WORDS.format(SUM.format('t', 180))}) AS b FROM s),
q AS (SELECT item_id AS query_id, list_distinct({WORDS.format('text')}) AS a FROM benchmark),
x AS (SELECT query_id, node_id, floor(len(list_intersect(a, b)) / sqrt(len(a) * len(b)) * 1e6 + 0.5) / 1e6 AS score FROM q CROSS JOIN m WHERE len(list_intersect(a, b)) > 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM x QUALIFY rank <= 5""")
def raptor_sections(read):
    return graph.section_search(questions(read), graph.section_tree(all_chunks(read)))


@query(f"""WITH {DENSE} SELECT query_id, chunk_id AS id, floor(0.45 * score * 1e6 + 0.5) / 1e6 AS final, rank FROM ranked WHERE rank <= 5""")
def fusion_dense_only(read):
    return fuse([dense(read, 5).select("query_id", "id", F.col("score").alias("semantic"))]).select("query_id", "id", "final", "rank")


#: The wording of a hypothetical answer.
GUESS = ("Hypothetical grounded answer for retrieval: ", ". Prefer concrete implementation details, dependencies, and retrieval evidence.")


def guesses(asked):
    """(query_id, qv): vectors of hypothetical answers to questions (query_id, question)."""
    return asked.select("query_id", lexical(F.concat(F.lit(GUESS[0]), trimmed("question"), F.lit(GUESS[1]))).alias("qv"))


@query()
def fusion_topk(read):
    """Six signals fused, as each question's plan allows: hypothetical answers for two modes, the graph for two, the section tree for one."""
    asked = questions(read).withColumn("mode", understand.plan(F.col("question"))["execution_mode"])
    of = lambda *modes: asked.where(F.col("mode").isin(*modes))
    chunked = all_chunks(read)
    first = hybrid(candidates(read, 12)).where("hybrid_rank <= 3").select("query_id", "id", F.col("combined").alias("semantic"))
    vectors = chunked.select(F.col("chunk_id").alias("id"), lexical(F.col("text")).alias("v"))
    hyde = topk(guesses(of("HYDE_RAG", "FULL_PIPELINE")), vectors, 12, digits=6).select("query_id", "id", F.col("score").alias("hyde"))
    walked = graph_signals(read, 12, of("GRAPH_RAG", "FULL_PIPELINE"))
    walked = walked.select("query_id", F.col("chunk_id").alias("id"), "proximity", "edge", (1 / (F.col("depth") + 1)).alias("depth"))
    tree = graph.section_tree(chunked)
    below = tree.where("level = 2").select(F.col("node_id").alias("id"), F.col("parent_id").alias("node_id"))
    raptor = graph.section_search(of("FULL_PIPELINE"), tree, 3).join(below, "node_id").select("query_id", "id", F.col("score").alias("raptor"))
    return fuse([first, hyde, walked, raptor], 3).select("query_id", "id", "final", "rank")
