"""Queries that prepare, verify, summarise and compare: query strings, reasons, snapshots, pages of lists, benchmarks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import safety, scoring, understand
from ..functions import text as tx
from ..operators import graph
from ..operators.chunking import sections
from ..operators.embedding import lexical, variance
from ..operators.search import WEIGHTS, hybrid, rerank
from .more import coarse, exact
from .operations import SAMPLES, r, samples
from .quality import (
    ANSWERED, EXPECTED, FAITH, FILLER_LIST, JUDGED, PLAN, QUESTIONS, RELEVANCE, STEM_W, SYNONYM_MAP, WINDOW, answered, any_like, asked, drift_report, embedded_sql, expected, has_any, like, redacted_sql, sql_string,
)
from .registry import ORACLES, query
from .retrieval import B, CHUNKS, CODES, DENSE, EDGES, FLAT, GRAPH, GUESS, HYBRID, NEAR_QUESTION, STEMSET, SUM, VECTOR_SCORES, WORDS, all_chunks, buckets, candidates, dense, found_entities, near_question, questions, shadow

REWRITTEN = rf"""p AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower(t), '[^a-z0-9_\s''-]', ' ', 'g'), {B}), '\s+'), lambda w: w <> '' AND w NOT IN {FILLER_LIST}), ' ') AS w FROM q),
rw AS (SELECT conv_id, turn, t, CASE WHEN w <> '' AND w <> lower(trim(t, {B})) THEN w END AS rewritten FROM p)"""


@query(rf"""WITH {QUESTIONS}, {REWRITTEN}, u AS (SELECT *, coalesce(rewritten, trim(t, {B})) AS used FROM rw),
m AS (SELECT k.key AS key, k.value AS v FROM (SELECT unnest(map_entries({SYNONYM_MAP})) AS k)),
w AS (SELECT conv_id, turn, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS w FROM (SELECT *, {WORDS.format('used')} AS ws FROM u)),
s AS (SELECT *, {STEM_W} AS s FROM w),
x AS (SELECT conv_id, turn, i, unnest(generate_series(1, len(v))) AS j, unnest(v) AS v FROM s JOIN m ON m.key = CASE WHEN w IN (SELECT key FROM m) THEN w ELSE s END),
d AS (SELECT conv_id, turn, v, min(i * 100 + j) AS place FROM x GROUP BY 1, 2, 3),
e AS (SELECT conv_id, turn, string_agg(v, ' ' ORDER BY place) AS more FROM d GROUP BY 1, 2)
SELECT u.conv_id, u.turn, md5(trim(used || coalesce(' ' || more, ''))) AS retrieval_query FROM u LEFT JOIN e ON e.conv_id = u.conv_id AND e.turn = u.turn""")
def retrieval_queries(read):
    """The string that is searched for: the rewritten question, or the question, and what it is expanded with."""
    return asked(read).select("conv_id", "turn", F.md5(understand.retrieval_query(F.col("t"))).alias("retrieval_query"))


MODERATE = "'Answer has moderate {0}: ' || array_to_string(list_filter([{1}], lambda x: x IS NOT NULL), ', ')"
FAITH_FACTORS = f"CASE WHEN s < 0.4 THEN 'low token overlap' END, CASE WHEN NOT {has_any('answer', scoring.GROUNDING)} THEN 'missing grounding signals' END, CASE WHEN {has_any('answer', scoring.HEDGING)} THEN 'ungrounded claims detected' END"
RELEVANCE_FACTORS = f"CASE WHEN s < 0.3 THEN 'limited keyword overlap' END, CASE WHEN l < 0.8 THEN 'unusual length' END, CASE WHEN regexp_matches(answer, {sql_string(scoring.EVASION)}) THEN 'possible evasion' END"


@query(f"""WITH x AS (WITH {FAITH} SELECT * FROM faith), y AS (WITH {RELEVANCE} SELECT * FROM rel),
fr AS (SELECT conv_id, turn, CASE WHEN faithfulness >= 0.8 THEN {sql_string(scoring.FAITHFUL_REASONS[0])} WHEN faithfulness >= 0.5 THEN {MODERATE.format('grounding', FAITH_FACTORS)} ELSE {sql_string(scoring.FAITHFUL_REASONS[1])} END AS faithful FROM x),
rr AS (SELECT conv_id, turn, CASE WHEN relevance >= 0.8 THEN {sql_string(scoring.RELEVANT_REASONS[0])} WHEN relevance >= 0.5 THEN {MODERATE.format('relevance', RELEVANCE_FACTORS)} ELSE {sql_string(scoring.RELEVANT_REASONS[1])} END AS relevant FROM y)
SELECT conv_id, turn, faithful, relevant FROM fr JOIN rr USING (conv_id, turn)""")
def eval_reasons(read):
    """Why an answer got its scores."""
    a, q = F.col("answer"), F.col("question")
    return answered(read).select("conv_id", "turn", scoring.faithfulness_reason(a, q).alias("faithful"), scoring.relevance_reason(q, a).alias("relevant"))


RERANK = f"""{DENSE}, near AS (SELECT r.*, c.text, q.text AS question, {STEMSET.format('q.text')} AS a, {STEMSET.format('c.text')} AS b FROM ranked r JOIN benchmark q ON q.item_id = r.query_id JOIN chunks c USING (chunk_id) WHERE rank <= 15),
o AS (SELECT *, coalesce(floor(len(list_intersect(a, b)) / nullif(sqrt(len(a) * len(b)), 0) * 1e9 + 0.5) / 1e9, 0) AS overlap FROM near),
s AS (SELECT *, floor((0.8 * score + 0.2 * overlap) * 1e9 + 0.5) / 1e9 AS rerank_score FROM o),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS after_rank FROM s)"""
ANSWER = f"""{RERANK}, ga AS (SELECT query_id, rerank_score >= 0.12 AS grounded, CASE WHEN rerank_score >= 0.12 THEN 'Based on the retrieved evidence: ' || {SUM.format(FLAT.format('text'), 180)} || ' [' || chunk_id || ']' ELSE 'No grounded answer was found.' END AS answer,
  CASE WHEN rerank_score >= 0.12 THEN chunk_id END AS citation FROM rr WHERE after_rank = 1)"""
ORACLES["grounded_answers"] = f"WITH {ANSWER} SELECT query_id, answer, citation FROM ga"


def grounded(read):
    """(query_id, grounded, answer): the best reranked chunk as an answer."""
    best = rerank(candidates(read, 15)).where("after_rank = 1")
    good = F.col("rerank_score") >= 0.12
    text = F.concat(F.lit("Based on the retrieved evidence: "), tx.summary("text", 180), F.lit(" ["), F.col("id"), F.lit("]"))
    return best.select("query_id", good.alias("grounded"), F.when(good, text).otherwise("No grounded answer was found.").alias("answer"))


KEYS = "regexp_extract_all(lower({0}), '[a-z0-9]{{3,}}')"


@query(f"""WITH {ANSWER}, res AS (SELECT query_id, count(*) FILTER (WHERE score >= 0.2) / count(*)::DOUBLE AS good, {KEYS.format("string_agg(c.text, ' ' ORDER BY rank)")}[1:800] AS b FROM ranked JOIN chunks c USING (chunk_id) WHERE rank <= 5 GROUP BY 1),
m AS (SELECT query_id, CASE WHEN grounded THEN 1.0 ELSE 0.35 END::DOUBLE AS groundedness, list_distinct({KEYS.format('answer')}) AS a, b, {r('good', 3)} AS accuracy FROM ga JOIN res USING (query_id)),
n AS (SELECT *, {r('len(list_intersect(a, b)) / greatest(1, len(a))::DOUBLE', 3)} AS overlap FROM m)
SELECT query_id, groundedness, overlap, accuracy, {r('groundedness * 0.4::DOUBLE + overlap * 0.35::DOUBLE + accuracy * 0.25::DOUBLE', 3)} AS pipeline_score, {r('overlap * 0.55::DOUBLE + groundedness * 0.45::DOUBLE', 3)} AS model_score FROM n""")
def rag_quality(read):
    """How well an answer is grounded, how much of it the results have, and how many results count; the results' first 800 words are compared."""
    top = candidates(read, 5)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ")  # five results a question
    results = top.groupBy("query_id").agg(tx.rounded(F.count_if(F.col("score") >= 0.2) / F.count("*"), 3).alias("accuracy"), F.slice(tx.keywords(texts), 1, 800).alias("b"))
    both = grounded(read).join(results, "query_id").withColumn("a", F.array_distinct(tx.keywords("answer"))).withColumn("groundedness", F.when(F.col("grounded"), 1.0).otherwise(0.35))
    both = both.withColumn("overlap", tx.rounded(F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size("a")), 3))
    g, o = F.col("groundedness"), F.col("overlap")
    return both.select("query_id", "groundedness", "overlap", "accuracy", tx.rounded(g * 0.4 + o * 0.35 + F.col("accuracy") * 0.25, 3).alias("pipeline_score"), tx.rounded(o * 0.55 + g * 0.45, 3).alias("model_score"))


@query(f"""WITH {ANSWERED}, k AS (SELECT *, list_distinct({KEYS.format('answer')}) AS x, {KEYS.format('question')} AS y FROM a),
v AS (SELECT *, trim(question, {B}) <> '' AND len(list_intersect(x, y)) >= greatest(2, floor(len(x) * 0.08)) AS grounded FROM k)
SELECT conv_id, turn, grounded, md5(CASE WHEN grounded THEN answer ELSE answer || chr(10) || chr(10) || {sql_string(scoring.WEAK_NOTE)} END) AS final FROM v""")
def grounding_checks(read):
    """Whether an answer shares words enough with its context; if not, a note is appended."""
    good = scoring.verified(F.col("answer"), F.col("question"))
    final = F.when(good, F.col("answer")).otherwise(F.concat("answer", F.lit("\n\n" + scoring.WEAK_NOTE)))
    return answered(read).select("conv_id", "turn", good.alias("grounded"), F.md5(final).alias("final"))


def routed(source: str) -> str:
    """The routing of ``source`` (query_id, t) in SQL."""
    keys = ", ".join("(" + " OR ".join(f"contains(l, {sql_string(k)})" for k in ks) + f") AS {n}" for n, ks in understand.ROUTING.items())
    return rf"""ra AS (SELECT query_id, lower(trim(t, {B})) AS l FROM {source}),
rb AS (SELECT *, greatest(1, len(list_filter(regexp_split_to_array(l, '\s+'), lambda w: w <> ''))) AS tokens, {keys} FROM ra),
rc AS (SELECT *, {r("least(1.0, tokens / 28.0::DOUBLE + CASE WHEN reasoning THEN 0.28 ELSE 0 END + CASE WHEN ambiguous THEN 0.2 ELSE 0 END + CASE WHEN comparative THEN 0.2 ELSE 0 END)", 3)} AS complexity,
  CASE WHEN comparative THEN 'comparative' WHEN procedural THEN 'procedural' WHEN ambiguous THEN 'ambiguous' WHEN reasoning THEN 'reasoning' ELSE 'simple' END AS kind FROM rb),
rd AS (SELECT *, CASE WHEN tokens <= 10 AND complexity < 0.35 THEN 'local-extractive' WHEN reasoning OR comparative THEN 'groq' ELSE 'ollama' END AS model FROM rc)"""


SIGNALS = f"""sg AS (SELECT query_id, count(*) AS n, {r('max(score)', 3)} AS top, {r('max(score) - min(score)', 3)} AS spread, {r('count(*) FILTER (WHERE score >= 0.2) / count(*)::DOUBLE', 3)} AS ratio, count(DISTINCT doc_id) AS docs FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 5 GROUP BY 1)"""


@query(f"""WITH {DENSE}, {SIGNALS}, qs AS (SELECT item_id AS query_id, text AS t FROM benchmark), {routed('qs')},
x AS (SELECT *, top < 0.45 OR spread < 0.08 OR ratio < 0.5 OR (docs <= 1 AND n <= 2) AS weak, top >= 0.82 AND spread >= 0.18 AND ratio >= 0.8 AND kind = 'simple' AS strong FROM rd JOIN sg USING (query_id)),
y AS (SELECT *, CASE WHEN weak THEN 'groq' WHEN strong THEN 'local-extractive' ELSE model END AS refined FROM x)
SELECT query_id, model, refined, array_to_string(list_filter([CASE WHEN top < 0.45 THEN 'weak-top-hit' END, CASE WHEN spread < 0.08 THEN 'tight-score-band' END, CASE WHEN ratio < 0.5 THEN 'low-grounded-ratio' END, CASE WHEN docs <= 1 AND n <= 2 THEN 'narrow-evidence' END, CASE WHEN strong THEN 'high-confidence-retrieval' END], lambda v: v IS NOT NULL), ',') AS triggers,
  {r("greatest(0.4::DOUBLE, least(0.98::DOUBLE, 0.6::DOUBLE + CASE WHEN kind = 'simple' THEN 0.2 WHEN kind IN ('reasoning', 'comparative') THEN 0.28 ELSE 0.18 END::DOUBLE - CASE WHEN refined = 'local-extractive' AND complexity > 0.5 THEN 0.2 ELSE 0 END::DOUBLE + greatest(-0.12::DOUBLE, least(0.12::DOUBLE, top * 0.1::DOUBLE + spread * 0.08::DOUBLE))))", 2)} AS confidence FROM y""")
def route_refined(read):
    """The model for each question before and after retrieval, why, and how sure that is."""
    d = dense(read, 5).withColumn("doc", F.split_part("id", F.lit(":"), F.lit(1)))
    signals = d.groupBy("query_id").agg(
        F.count("*").alias("n"), tx.rounded(F.max("score"), 3).alias("top"), tx.rounded(F.max("score") - F.min("score"), 3).alias("spread"),
        tx.rounded(F.count_if(F.col("score") >= 0.2) / F.count("*"), 3).alias("ratio"), F.countDistinct("doc").alias("docs"),
    )
    f = questions(read).select("query_id", understand.routing_features(F.col("question")).alias("f")).withColumn("model", understand.route(F.col("f"))).join(signals, "query_id")
    f = f.withColumn("x", understand.refine(F.col("model"), F.col("top"), F.col("spread"), F.col("ratio"), F.col("docs"), F.col("n"), F.col("f.intent")))
    sure = understand.routing_confidence(F.col("f"), F.col("x.model"), F.col("top"), F.col("spread"))
    return f.select("query_id", "model", F.col("x.model").alias("refined"), F.array_join("x.triggers", ",").alias("triggers"), sure.alias("confidence"))


INTENT = "CASE " + " ".join(f"WHEN {like(p)} THEN {sql_string(n)}" for n, p, _ in understand.INTENTS) + " ELSE 'unknown' END"


@query(rf"""WITH {DENSE}, {NEAR_QUESTION}, va AS (SELECT item_id, greatest(0, least(1, 1.0::DOUBLE / 64 - pow(sum(c) / sqrt(sum(c * c)) / 64, 2))) AS v FROM qb GROUP BY 1),
z AS (SELECT q.item_id AS query_id, {INTENT} AS kind, len(list_filter(regexp_split_to_array(trim(t, {B}), '\s+'), lambda w: w <> '')) AS n, coalesce(v, 0) AS v FROM (SELECT item_id, text AS t FROM benchmark) q LEFT JOIN va USING (item_id)),
y AS (SELECT z.query_id, kind, coalesce(overlap, 0.6::DOUBLE) AS quality, CASE WHEN kind IN ('factual', 'procedural') AND n <= 10 AND v <= 0.45 THEN 0.95 WHEN kind IN ('unknown', 'exploratory', 'comparative') OR n > 18 OR v >= 0.65 THEN 0.85 ELSE 0.9 END::DOUBLE AS base FROM z LEFT JOIN shadow USING (query_id))
SELECT query_id, kind, quality, {r('CASE WHEN quality < 0.45 THEN least(0.97::DOUBLE, base + 0.03::DOUBLE) ELSE base END', 2)} AS threshold FROM y""")
def cache_thresholds(read):
    """The similarity that a cached answer needs for each question; more where a cached one, the nearest other question's, was poor."""
    q = questions(read).withColumn("kind", understand.intent(F.col("question"))["intent"]).withColumn("e", lexical(F.col("question"))).withColumn("v", variance(F.col("e")))
    q = q.join(shadow(read).select("query_id", "overlap"), "query_id", "left").withColumn("quality", F.coalesce("overlap", F.lit(0.6)))
    return q.select("query_id", "kind", "quality", understand.cache_threshold(F.col("question"), F.col("kind"), F.col("v"), F.col("quality")).alias("threshold"))


@query(f"""WITH {DENSE}, {NEAR_QUESTION}, c AS (SELECT n.query_id, r.chunk_id FROM nearest n JOIN ranked r ON r.query_id = n.cached AND rank <= 5 WHERE similarity < 0.92),
b AS (SELECT r.query_id, r.chunk_id, r.rank, c.chunk_id IS NOT NULL AS boosted, CASE WHEN c.chunk_id IS NULL THEN r.score ELSE floor((r.score + 0.03) * 1e6 + 0.5) / 1e6 END AS score FROM ranked r LEFT JOIN c ON c.query_id = r.query_id AND c.chunk_id = r.chunk_id WHERE rank <= 15)
SELECT query_id, chunk_id AS id, rank, boosted, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM b""")
def cache_boosted(read):
    """Candidates for reranking, three for each result wanted, those of a near miss in the cache (a question that is like this one, but not enough) a little higher."""
    k = 5
    d = dense(read, max(3 * k, k + 2, 5))
    missed = near_question(read).where("similarity < 0.92").select("query_id", "cached")
    cached = missed.join(d.where(F.col("rank") <= k).select(F.col("query_id").alias("cached"), "id"), "cached").select("query_id", "id", F.lit(True).alias("boosted"))
    b = d.join(cached, ["query_id", "id"], "left").withColumn("boosted", F.coalesce("boosted", F.lit(False)))
    b = b.withColumn("score", F.when(F.col("boosted"), tx.rounded(F.col("score") + 0.03, 6)).otherwise(F.col("score")))
    return b.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


SNAPSHOT = f"""{DENSE}, sn AS (SELECT query_id, rank, chunk_id, score, sha256(c.text) AS text_hash, left({FLAT.format('c.text')}, 140) AS preview FROM ranked JOIN chunks c USING (chunk_id) WHERE rank <= 5)"""


@query(f"WITH {SNAPSHOT} SELECT query_id, rank, chunk_id, score, text_hash, md5(preview) AS preview FROM sn")
def replay_snapshots(read):
    """What a replay compares with: each result's place, score, hash and beginning."""
    return candidates(read, 5).select("query_id", "rank", F.col("id").alias("chunk_id"), "score", F.sha2("text", 256).alias("text_hash"), F.md5(F.substring(tx.collapsed("text"), 1, 140)).alias("preview"))


@query(f"WITH {SNAPSHOT} SELECT query_id, count(*) AS results, count(*) > 0 AND count(*) = max(rank) AND bool_and(chunk_id IS NOT NULL AND score IS NOT NULL AND length(text_hash) = 64 AND preview <> '') AS complete FROM sn GROUP BY 1")
def snapshot_completeness(read):
    """Whether a snapshot has all that a replay needs."""
    s = replay_snapshots(read)
    whole = F.col("chunk_id").isNotNull() & F.col("score").isNotNull() & (F.length("text_hash") == 64) & F.col("preview").isNotNull()
    return s.groupBy("query_id").agg(F.count("*").alias("results"), (F.every(whole) & (F.count("*") == F.max("rank"))).alias("complete"))


@query(f"WITH {CHUNKS} SELECT chunk_id, n_chars FROM chunks JOIN documents USING (doc_id) WHERE source IS NOT DISTINCT FROM 'src0' AND lang IS NOT DISTINCT FROM 'en' AND n IS NOT DISTINCT FROM 1")
def filtered_chunks(read):
    """Chunks that agree in all of several attributes; an attribute nobody has fits nothing."""
    rows = all_chunks(read).join(read("documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return rows.where(tx.agrees(rows, {"source": "src0", "lang": "en", "section_chunk_index": 1})).select("chunk_id", "n_chars")


@query(f"WITH {SAMPLES} SELECT event_id, event_type FROM s WHERE event_type = 'error' AND k >= 5 ORDER BY event_id LIMIT 50 OFFSET 10")
def dead_letter_page(read):
    """A page of the dead letters of one kind, in the order they came."""
    return samples(read).where("event_type = 'error' and k >= 5").orderBy("event_id").offset(10).limit(50).select("event_id", "event_type")


def audit(rows, user=None, action=None, newest=True, limit=100, offset=0):
    """A page of events: filters if given, at most 500 rows, the newest or the oldest first."""
    if user is not None:
        rows = rows.where(F.col("user_id") == user)
    if action is not None:
        rows = rows.where(F.col("event_type") == action)
    turn = F.desc if newest else F.asc
    return rows.orderBy(turn("ts"), turn("event_id")).offset(max(0, offset)).limit(min(500, max(1, limit)))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 500 OFFSET 20")
def audit_page(read):
    return audit(samples(read), action="view", newest=False, limit=1000, offset=20).select("event_id", "user_id")


@query(f"WITH {DENSE} SELECT query_id, rank, chunk_id, CAST(doc_id AS VARCHAR) AS document, n AS section_chunk_index, start_offset, start_offset + length(text) AS end_offset, 'document' AS basis, 'api-lexical' AS provider, CAST(64 AS BIGINT) AS dimensions, score FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 3")
def dev_mode(read):
    """Results with where they come from and how they were embedded."""
    where = all_chunks(read).select(F.col("chunk_id"), F.col("doc_id").cast("string").alias("document"), "section_chunk_index", "start_offset", "end_offset", F.col("offset_basis").alias("basis"))
    d = dense(read, 3).withColumnRenamed("id", "chunk_id").join(where, "chunk_id")
    return d.select("query_id", "rank", "chunk_id", "document", "section_chunk_index", "start_offset", "end_offset", "basis", F.lit("api-lexical").alias("provider"), F.lit(64).alias("dimensions"), "score")


@query(f"WITH {SAMPLES} SELECT event_id, CASE WHEN value - 50 >= 0 THEN value - 50 ELSE 0 END AS duration, CASE WHEN k >= 3 THEN k END AS retries, event_type AS component FROM s")
def metric_samples(read):
    """Samples with what no duration or count can be replaced: negative durations by 0, missing counts by null."""
    over = F.col("value") - 50
    return samples(read).select("event_id", tx.at_least_zero(over).alias("duration"), F.when(F.col("k") >= 3, F.col("k")).alias("retries"), F.col("event_type").alias("component"))


@query("SELECT doc_id, CASE WHEN doc_id IS NULL THEN 'doc_id: required' WHEN text IS NULL OR text = '' THEN 'text: required' WHEN lang NOT IN ('en', 'de') THEN 'lang: not allowed' WHEN n_chars <> length(text) THEN 'n_chars: wrong' WHEN length(text) > 20000 THEN 'text: too long' END AS issue FROM documents")
def validation_issues(read):
    """The first rule of the documents' contract that each row breaks; null if none."""
    rules = [
        (F.col("doc_id").isNull(), "doc_id: required"), (F.col("text").isNull() | (F.col("text") == ""), "text: required"), (~F.col("lang").isin("en", "de"), "lang: not allowed"),
        (F.col("n_chars") != F.length("text"), "n_chars: wrong"), (F.length("text") > 20000, "text: too long"),
    ]
    return read("documents").select("doc_id", tx.first_issue(rules).alias("issue"))


PARTED = "replace(text, chr(10), chr(10) || chr(10))"


@query(rf"""WITH d AS (SELECT doc_id, {PARTED} AS t FROM documents), p AS (SELECT doc_id, regexp_split_to_array(t, '(?:\r?\n){{2,}}') AS parts, regexp_extract_all(t, '(?:\r?\n){{2,}}') AS gaps FROM d),
i AS (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM p),
x AS (SELECT doc_id, i, parts[i] AS part, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gaps[1:i - 1], lambda x: length(x))), 0) AS start FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM x WHERE trim(part, {B}) <> '')
SELECT doc_id, 'section-' || n AS section_id, CAST(start + length(part) - length(ltrim(part, {B})) AS BIGINT) AS start_offset, md5(trim(part, {B})) AS text FROM k""")
def sectioned_documents(read):
    """Sections of the documents with a blank line for every line's end, so that there are several."""
    docs = read("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return sections(docs).select("doc_id", "section_id", "start_offset", F.md5("text").alias("text"))


@query(rf"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array({PARTED}, '\n\s*\n')) AS p FROM documents) SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(trim(p, {B}))) AS BIGINT) AS chars FROM p WHERE trim(p, {B}) <> '' GROUP BY 1""")
def paragraphs(read):
    """Paragraphs between lines of white space only."""
    p = read("documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit("\n\n")), r"\n\s*\n")).alias("p")).select("doc_id", tx.trimmed("p").alias("p")).where("p <> ''")
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).alias("chars"))


@query(f"""WITH w AS (SELECT item_id, unnest({WORDS.format('text')}) AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS c FROM w GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM c GROUP BY 1)
SELECT item_id, w AS word, {r('c / n', 6)} AS x FROM c JOIN n USING (item_id)""")
def embed_vocabulary(read):
    """Word counts over the whole vocabulary, scaled to length 1; a row for each word that is not 0."""
    c = read("benchmark").select("item_id", F.explode(tx.words("text")).alias("word")).groupBy("item_id", "word").agg(F.count("*").alias("c"))
    n = c.groupBy("item_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("n"))
    return c.join(n, "item_id").select("item_id", "word", tx.rounded(F.col("c") / F.col("n"), 6).alias("x"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents")
def index_list(read):
    """Each owner's documents, the largest first."""
    return read("documents").select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("place"))


PROVIDERS = f"""{SAMPLES}, g AS (SELECT event_type AS provider, count(*) AS requests, {r('avg(value)', 2)} AS avg_latency, quantile_disc(value, 0.95) AS p95_latency, {r('avg(CASE WHEN k >= 5 THEN 1.0 ELSE 0.0 END)', 4)} AS expected_rate, {r('avg(value * 0.001)', 6)} AS avg_cost, {r('sum(value * 0.001)', 6)} AS total_cost FROM s WHERE NOT failed GROUP BY 1)"""


@query(f"WITH {PROVIDERS} SELECT * FROM g")
def provider_benchmark(read):
    """Completed requests of each provider: latencies, hits, costs."""
    cost = F.col("value") * 0.001
    return samples(read).where("not failed").groupBy(F.col("event_type").alias("provider")).agg(
        F.count("*").alias("requests"), tx.rounded(F.avg("value"), 2).alias("avg_latency"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95_latency"),
        tx.rounded(F.avg(F.when(F.col("k") >= 5, 1.0).otherwise(0.0)), 4).alias("expected_rate"), tx.rounded(F.avg(cost), 6).alias("avg_cost"), tx.rounded(F.sum(cost), 6).alias("total_cost"),
    )


@query(f"WITH {PROVIDERS} SELECT (SELECT provider FROM g ORDER BY avg_latency, provider LIMIT 1) AS fastest, (SELECT provider FROM g ORDER BY total_cost, provider LIMIT 1) AS cheapest, (SELECT provider FROM g ORDER BY expected_rate DESC, provider LIMIT 1) AS best")
def best_providers(read):
    g = provider_benchmark(read)
    least = lambda c: F.min_by("provider", F.struct(c, F.col("provider")))
    return g.agg(least(F.col("avg_latency")).alias("fastest"), least(F.col("total_cost")).alias("cheapest"), least(-F.col("expected_rate")).alias("best"))


def mean(x: str, scale: int = 1000) -> str:
    return f"(sum(CAST(round(({x}) * {scale}) AS BIGINT))::DOUBLE / ({scale} * count({x})))"


EVALS = f"""x AS (WITH {FAITH} SELECT conv_id, turn, faithfulness FROM faith), y AS (WITH {RELEVANCE} SELECT conv_id, turn, relevance FROM rel), ev AS (SELECT *, conv_id % 3 AS variant FROM x JOIN y USING (conv_id, turn))"""


def evals(read):
    a, q = F.col("answer"), F.col("question")
    return answered(read).select((F.col("conv_id") % 3).alias("variant"), scoring.faithfulness(a, q).alias("faithfulness"), scoring.relevance(q, a).alias("relevance"))


@query(f"""WITH {EVALS} SELECT count(*) AS samples, count(*) FILTER (WHERE faithfulness >= 0.5 AND relevance >= 0.5) AS passed, {r('avg(CASE WHEN faithfulness >= 0.5 AND relevance >= 0.5 THEN 1.0 ELSE 0.0 END)', 4)} AS pass_rate,
  {r(mean('faithfulness'), 3)} AS faithfulness, {r(mean('relevance'), 3)} AS relevance, {r(mean('(faithfulness + relevance) / 2', 2000), 3)} AS average FROM ev""")
def eval_runs(read):
    """A sample passes if all its scores do; the mean of each score."""
    good = (F.col("faithfulness") >= 0.5) & (F.col("relevance") >= 0.5)
    return evals(read).agg(
        F.count("*").alias("samples"), F.count_if(good).alias("passed"), tx.rounded(F.avg(F.when(good, 1.0).otherwise(0.0)), 4).alias("pass_rate"),
        tx.rounded(tx.exact_mean(F.col("faithfulness")), 3).alias("faithfulness"), tx.rounded(tx.exact_mean(F.col("relevance")), 3).alias("relevance"),
        tx.rounded(tx.exact_mean((F.col("faithfulness") + F.col("relevance")) / 2, 2000), 3).alias("average"),
    )


@query(f"WITH {EVALS} SELECT variant, count(*) AS requests, {r(mean('faithfulness'), 4)} AS faithfulness, {r(mean('relevance'), 4)} AS relevance, {r(mean('(faithfulness + relevance) / 2', 2000), 4)} AS quality FROM ev GROUP BY 1")
def model_benchmark(read):
    """Models, here thirds of the conversations, by the mean of their answers' scores."""
    of = lambda c, scale=1000: tx.rounded(tx.exact_mean(c, scale), 4)
    return evals(read).groupBy("variant").agg(
        F.count("*").alias("requests"), of(F.col("faithfulness")).alias("faithfulness"), of(F.col("relevance")).alias("relevance"), of((F.col("faithfulness") + F.col("relevance")) / 2, 2000).alias("quality")
    )


@query(f"""WITH {EVALS}, m AS (SELECT variant, 'faithfulness-' || turn % 4 AS metric, avg(faithfulness) AS v FROM ev GROUP BY 1, 2) SELECT metric, {r('b.v - a.v', 4)} AS delta FROM m a JOIN m b USING (metric) WHERE a.variant = 0 AND b.variant = 1""")
def metric_deltas(read):
    """Differences of the metrics that both runs have."""
    a, q = F.col("answer"), F.col("question")
    m = answered(read).groupBy((F.col("conv_id") % 3).alias("variant"), F.concat(F.lit("faithfulness-"), (F.col("turn") % 4).cast("string")).alias("metric")).agg(F.avg(scoring.faithfulness(a, q)).alias("v"))
    both = m.where("variant = 0").select("metric", F.col("v").alias("a")).join(m.where("variant = 1").select("metric", F.col("v").alias("b")), "metric")
    return both.select("metric", tx.rounded(F.col("b") - F.col("a"), 4).alias("delta"))


DRIFT = f"""dr AS ({ORACLES['drift_report']})"""


@query(f"""WITH {DRIFT} SELECT count(*) AS queries, count(*) FILTER (WHERE regressed) AS degraded, count(*) FILTER (WHERE NOT regressed AND diff > 0) AS improved, count(*) FILTER (WHERE NOT regressed AND diff <= 0) AS stable,
  count(*) FILTER (WHERE severity = 'critical') AS critical, {r('avg(current)', 4)} AS recall, array_to_string(list_concat(coalesce(list(query_id ORDER BY query_id) FILTER (WHERE regressed), []), coalesce(list(query_id ORDER BY query_id) FILTER (WHERE NOT regressed AND diff > 0), [])), ',') AS affected FROM dr""")
def drift_summary(read):
    """How many questions a new retrieval serves worse, better and alike, and which ones: the degraded, then the improved."""
    d = drift_report(read)
    worse, better = F.col("regressed"), ~F.col("regressed") & (F.col("diff") > 0)
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("query_id"))))  # noqa: E731  golden questions, not documents
    return d.agg(
        F.count("*").alias("queries"), F.count_if(worse).alias("degraded"), F.count_if(better).alias("improved"), F.count_if(~worse & ~better).alias("stable"),
        F.count_if(F.col("severity") == "critical").alias("critical"), tx.rounded(F.avg("current"), 4).alias("recall"), F.array_join(F.concat(ids(worse), ids(better)), ",").alias("affected"),
    )


@query(f"WITH {DENSE} SELECT count(*) AS n, floor(min(score) * 1e12 + 0.5) / 1e12 AS least, floor(max(score) * 1e12 + 0.5) / 1e12 AS most, {r('avg(score)', 9)} AS mean FROM ranked WHERE rank <= 5")
def score_summary(read):
    return dense(read, 5).agg(F.count("*").alias("n"), tx.rounded(F.min("score"), 12).alias("least"), tx.rounded(F.max("score"), 12).alias("most"), tx.rounded(F.avg("score"), 9).alias("mean"))


@query(f"""WITH {EDGES}, w AS (SELECT source AS node, target AS other, chunks FROM pairs UNION ALL SELECT target, source, chunks FROM pairs),
o AS (SELECT node, other, chunks, row_number() OVER (PARTITION BY node ORDER BY least(1.0::DOUBLE, 0.52 + 0.08 * (chunks - 1)) DESC, other) AS place FROM w) SELECT node, other, place FROM o WHERE place <= 2""")
def strongest_edges(read):
    """The two edges of each entity that are walked first."""
    both = graph.both_ways(graph.meetings(graph.labels(all_chunks(read)))).withColumnsRenamed({"label": "node", "to": "other"})
    return both.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "other"))).where("place <= 2").select("node", "other", "place")


@query(f"""WITH b AS (SELECT 'dense' AS run, query_id, score, CAST(NULL AS DOUBLE) AS sparse FROM (WITH {DENSE} SELECT * FROM ranked WHERE rank = 1)), h1 AS (SELECT 'hybrid' AS run, query_id, score, sparse FROM (WITH {HYBRID} SELECT * FROM h WHERE hybrid_rank = 1)) SELECT * FROM b UNION ALL SELECT * FROM h1""")
def collected_runs(read):
    """Snapshots of two runs in one table; what a run has no column for is null."""
    first = dense(read, 1).select(F.lit("dense").alias("run"), "query_id", "score")
    second = hybrid(candidates(read, 20)).where("hybrid_rank = 1").select(F.lit("hybrid").alias("run"), "query_id", "score", "sparse")
    return first.unionByName(second, allowMissingColumns=True)


def preview_sql(column: str, most: int) -> str:
    return f"CASE WHEN length({column}) > {most} THEN left({column}, {most - 3}) || '...' ELSE {column} END"


@query(f"WITH f AS (SELECT doc_id, {FLAT.format('text')} AS f FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5({preview_sql('f', 160)}) AS of_160, md5({preview_sql('f', 120)}) AS of_120, md5(left(f, 140)) AS of_140 FROM f")
def previews(read):
    d = read("documents").where("text is not null").select("doc_id", tx.collapsed("text").alias("f"))
    return d.select("doc_id", F.md5(tx.preview(F.col("f"), 160)).alias("of_160"), F.md5(tx.preview(F.col("f"), 120)).alias("of_120"), F.md5(F.substring("f", 1, 140)).alias("of_140"))


@query(f"""WITH {ANSWER} SELECT query_id, len(list_filter({WORDS.format('q.text')}[1:3], lambda w: NOT contains(lower(ga.answer), w))) = 0 AS contains_all FROM ga JOIN benchmark q ON q.item_id = query_id""")
def contains_expected(read):
    """Whether an answer has all the words expected of it, here the question's first three, in any case."""
    both = grounded(read).join(questions(read), "query_id")
    return both.select("query_id", tx.contains_all(F.col("answer"), F.slice(tx.words("question"), 1, 3)).alias("contains_all"))


@query("SELECT item_id, left(sha256(text), 16) AS version, left(sha256(text), 32) AS document, left(sha256(lower(text) || '::' || item_id || '::ctx::' || left(sha256(text), 16)), 24) AS cache_key FROM benchmark")
def cache_keys(read):
    """Versions, document names and cache keys: prefixes of SHA-256 in hexadecimal."""
    short = lambda c, n: F.substring(F.sha2(c, 256), 1, n)
    key = F.concat_ws("::", F.lower("text"), F.col("item_id").cast("string"), F.lit("ctx"), short(F.col("text"), 16))
    return read("benchmark").select("item_id", short(F.col("text"), 16).alias("version"), short(F.col("text"), 32).alias("document"), short(key, 24).alias("cache_key"))


@query("SELECT DISTINCT p_brand, lower(regexp_replace(p_brand, '([A-Z])', '_\\1', 'g')) AS snake FROM part")
def snake_names(read):
    return read("part").select("p_brand", tx.snake(F.col("p_brand")).alias("snake")).distinct()


@query("SELECT c.conv_id, c.turn, x.turn AS related, x.role FROM (SELECT conv_id, turn, unnest([turn - 1, turn + 1]) AS other FROM conversations) c JOIN conversations x ON x.conv_id = c.conv_id AND x.turn = c.other")
def related_turns(read):
    """Rows that a row's list of ids names, here the turns before and after."""
    c = read("conversations")
    named = c.select("conv_id", "turn", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("related"))
    return named.join(c.select("conv_id", F.col("turn").alias("related"), "role"), ["conv_id", "related"]).select("conv_id", "turn", "related", "role")


MODES = f"""{EXPECTED}, {HYBRID}, t AS (SELECT query_id, c.doc_id, min(rank) AS rank, min(hybrid_rank) AS hybrid_rank, max(score) AS score, max(combined) AS combined FROM h JOIN chunks c USING (chunk_id) GROUP BY 1, 2),
e AS (SELECT x.item_id AS query_id, min(rank) AS r0, min(hybrid_rank) AS r1, coalesce(max(score), 0) AS s0, coalesce(max(combined), 0) AS s1 FROM expected x LEFT JOIN t ON t.query_id = x.item_id AND t.doc_id = x.doc_id GROUP BY 1),
m AS (SELECT count(*) AS queries, {', '.join(f"avg(CASE WHEN r{i} <= 5 THEN 1.0 ELSE 0.0 END) AS recall{i}, avg(CASE WHEN r{i} = 1 THEN 1.0 ELSE 0.0 END) AS top{i}, avg(coalesce(1.0::DOUBLE / r{i}, 0)) AS mrr{i}, avg(s{i}) AS score{i}" for i in (0, 1))} FROM e)"""


@query(f"""WITH {MODES} SELECT queries, {r('recall1 - recall0', 4)} AS recall_gain, {r('top1 - top0', 4)} AS top1_gain, {r('mrr1 - mrr0', 4)} AS mrr_gain, {r('score1 - score0', 4)} AS score_gain, recall1 - recall0 >= 0 AND mrr1 - mrr0 >= 0 AND score1 - score0 > 0 AS passed FROM m""")
def hybrid_gate(read):
    """What hybrid retrieval gains over dense, and whether that lets it pass: no recall or rank lost, and a better score."""
    top = hybrid(candidates(read, 20)).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.min("hybrid_rank").alias("hybrid_rank"), F.max("score").alias("score"), F.max("combined").alias("combined"))
    zero = F.lit(0.0)
    e = expected(read).join(top, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.min("rank").alias("r0"), F.min("hybrid_rank").alias("r1"), F.coalesce(F.max("score"), zero).alias("s0"), F.coalesce(F.max("combined"), zero).alias("s1")
    )
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    of = lambda i: [share(F.col(f"r{i}") <= 5).alias(f"recall{i}"), share(F.col(f"r{i}") == 1).alias(f"top{i}"), F.avg(F.coalesce(1.0 / F.col(f"r{i}"), zero)).alias(f"mrr{i}"), F.avg(f"s{i}").alias(f"score{i}")]
    m = e.agg(F.count("*").alias("queries"), *of(0), *of(1))
    gain = lambda n: F.col(f"{n}1") - F.col(f"{n}0")
    passed = (gain("recall") >= 0) & (gain("mrr") >= 0) & (gain("score") > 0)
    return m.select("queries", *[tx.rounded(gain(n), 4).alias(f"{name}_gain") for n, name in (("recall", "recall"), ("top", "top1"), ("mrr", "mrr"), ("score", "score"))], passed.alias("passed"))


@query(f"""WITH b AS (WITH {VECTOR_SCORES} SELECT query_id, id AS want FROM ranked WHERE rank = 1), f AS (WITH {CODES.format(127)}),
j AS (SELECT b.query_id, f.rank FROM b LEFT JOIN f ON f.query_id = b.query_id AND f.id = b.want)
SELECT count(*) AS queries, {r('avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END)', 4)} AS top1, {r('avg(coalesce(1.0::DOUBLE / rank, 0))', 4)} AS mrr FROM j""")
def backend_benchmark(read):
    """How well a second backend, of int8 codes, finds what the first one finds."""
    want = exact(read).where("rank = 1").select("query_id", F.col("id").alias("want"))
    found = coarse(read, 127).select("query_id", F.col("id").alias("want"), "rank")
    j = want.join(found, ["query_id", "want"], "left")
    return j.agg(F.count("*").alias("queries"), tx.rounded(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 4).alias("top1"), tx.rounded(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))


@query(f"""WITH {EXPECTED}, {DENSE}, x AS (SELECT item_id AS query_id, doc_id FROM expected), t AS (SELECT query_id, doc_id FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 3),
h AS (SELECT t.query_id, count(*) FILTER (WHERE x.doc_id IS NOT NULL) AS hits, count(*) AS n FROM t LEFT JOIN x ON x.query_id = t.query_id AND x.doc_id = t.doc_id WHERE t.query_id IN (SELECT query_id FROM x) GROUP BY 1)
SELECT count(*) AS queries, {r('avg(hits / n::DOUBLE)', 4)} AS precision, {r('avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END)', 4)} AS source_hit_rate FROM h""")
def precision_at_k(read):
    """The share of results from documents expected, and of questions with any such result."""
    x = expected(read)
    t = dense(read, 3).select("query_id", F.split_part("id", F.lit(":"), F.lit(1)).cast("bigint").alias("doc_id"))
    h = t.join(x.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").join(x.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    return h.agg(F.count("*").alias("queries"), tx.rounded(F.avg(F.col("hits") / F.col("n")), 4).alias("precision"), tx.rounded(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 4).alias("source_hit_rate"))


@query(f"""WITH {ANSWERED}, x AS (SELECT *, length(answer) > 3 * length(question) AND NOT regexp_matches(answer, '(?i)according to|based on|the document|retrieved|source|cited') AS long FROM a),
y AS (SELECT *, {any_like(safety.INJECTION).replace('(t,', '(answer,')} OR {any_like(safety.JAILBREAK).replace('(t,', '(answer,')} OR {any_like(safety.LEAKAGE).replace('(t,', '(answer,')} AS bad, {redacted_sql(embedded_sql('answer'))} AS clean FROM x),
z AS (SELECT CASE WHEN bad THEN 'block' WHEN clean <> answer THEN 'sanitize' WHEN long THEN 'review' ELSE 'allow' END AS decision FROM y)
SELECT decision, count(*) AS n FROM z GROUP BY 1""")
def guardrail_summary(read):
    """Decisions on answers, with a review of those that are long beside their context and name no source."""
    return safety.guard(answered(read), "answer", context="question").groupBy("decision").agg(F.count("*").alias("n"))
ORACLES["quantisation_experiment"] = f"""WITH w AS (WITH {VECTOR_SCORES} SELECT query_id, id AS want FROM ranked WHERE rank = 1), a AS (WITH {CODES.format(127)}), b AS (WITH {CODES.format(7)}),
z AS (SELECT count(*) AS n, sum(len(embedding)) AS cells, sum(len(embedding) // 2 + 1) AS pairs FROM embeddings),
p(precision, recall_at_1) AS (SELECT 'fp32', 1.0::DOUBLE UNION ALL SELECT 'int8', {r('(SELECT avg(CASE WHEN want = id THEN 1.0 ELSE 0.0 END) FROM w JOIN a USING (query_id) WHERE rank = 1)', 4)}
  UNION ALL SELECT 'int4', {r('(SELECT avg(CASE WHEN want = id THEN 1.0 ELSE 0.0 END) FROM w JOIN b USING (query_id) WHERE rank = 1)', 4)})
SELECT precision, recall_at_1, CAST(CASE precision WHEN 'fp32' THEN cells * 4 WHEN 'int8' THEN cells + 8 * n ELSE pairs + 8 * n END AS BIGINT) AS bytes FROM p CROSS JOIN z"""

HYDE = f"""guess AS (SELECT item_id, {sql_string(GUESS[0])} || trim(text, {B}) || {sql_string(GUESS[1])} AS text FROM benchmark), hb AS ({buckets('guess', 'item_id', 'text')}), hn AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM hb GROUP BY 1),
hd AS (SELECT item_id, chunk_id, sum(hb.c * cb.c) AS d FROM hb JOIN cb USING (bucket) GROUP BY 1, 2),
hs AS (SELECT q.item_id AS query_id, c.chunk_id, coalesce(floor(d / (hn.n * cn.n) * 1e6 + 0.5) / 1e6, 0) AS score FROM benchmark q CROSS JOIN chunks c LEFT JOIN hd ON hd.item_id = q.item_id AND hd.chunk_id = c.chunk_id LEFT JOIN hn ON hn.item_id = q.item_id LEFT JOIN cn ON cn.chunk_id = c.chunk_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hs)"""
ORACLES["hyde_delta"] = f"""WITH {DENSE}, {HYDE} SELECT a.query_id, a.score AS before, b.score AS after, {r('b.score - a.score', 6)} AS change FROM ranked a JOIN hr b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 1"""

ORACLES["context_budget"] = f"""WITH {DENSE}, t AS (SELECT query_id, rank, CAST(ceil(len(string_split({FLAT.format('text')}, ' ')) * 1.3) AS BIGINT) AS tokens FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 10),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM t), k AS (SELECT query_id, count(*) AS results, count(*) FILTER (WHERE upto <= {WINDOW}) AS kept, CAST(sum(tokens) AS BIGINT) AS tokens FROM u GROUP BY 1)
SELECT query_id, results, kept, tokens, {r('kept / results::DOUBLE', 3)} AS kept_ratio, kept < results AS truncated FROM k"""

TREE_SQL = ORACLES["raptor_sections"].replace("rank <= 5", "rank <= 3")
ORACLES["fusion_topk"] = f"""WITH md AS (WITH q AS (SELECT item_id AS conv_id, 0 AS turn, text AS t FROM benchmark), {PLAN} SELECT conv_id AS query_id, execution_mode AS mode FROM e),
w1 AS (WITH {HYBRID.replace('WHERE rank <= 20', 'WHERE rank <= 12')} SELECT query_id, chunk_id AS id, combined AS semantic FROM h WHERE hybrid_rank <= 3),
w2 AS (WITH {DENSE}, {HYDE} SELECT query_id, chunk_id AS id, score AS hyde FROM hr WHERE rank <= 12),
w3 AS (WITH {GRAPH} SELECT query_id, chunk_id AS id, proximity, edge, 1.0::DOUBLE / (depth + 1) AS depth FROM gr WHERE rank <= 12),
w4 AS (SELECT query_id, chunk_id AS id, score AS raptor FROM ({TREE_SQL}) t JOIN (WITH {CHUNKS} SELECT chunk_id, doc_id || ':section-1' AS node_id FROM chunks) c USING (node_id)),
un AS (SELECT query_id, id, semantic, NULL AS proximity, NULL AS edge, NULL AS depth, NULL AS hyde, NULL AS raptor FROM w1 UNION ALL SELECT query_id, id, NULL, NULL, NULL, NULL, hyde, NULL FROM w2 JOIN md USING (query_id) WHERE mode IN ('HYDE_RAG', 'FULL_PIPELINE')
  UNION ALL SELECT query_id, id, NULL, proximity, edge, depth, NULL, NULL FROM w3 JOIN md USING (query_id) WHERE mode IN ('GRAPH_RAG', 'FULL_PIPELINE') UNION ALL SELECT query_id, id, NULL, NULL, NULL, NULL, NULL, raptor FROM w4 JOIN md USING (query_id) WHERE mode = 'FULL_PIPELINE'),
best AS (SELECT query_id, id, {', '.join(f'coalesce(max({c}), 0)::DOUBLE AS {c}' for c in WEIGHTS)} FROM un GROUP BY 1, 2),
fin AS (SELECT query_id, id, {r(' + '.join(f'{w}::DOUBLE * {c}' for c, w in WEIGHTS.items()), 6)} AS final FROM best),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM fin) SELECT * FROM ra WHERE rank <= 3"""

CLAMP = "greatest(0.0, least(1.0, {0}))"
ORACLES["confidence"] = f"""WITH {JUDGED}, v AS (SELECT *, {CLAMP.format('top')} * 0.6::DOUBLE + {CLAMP.format('mean')} * 0.4::DOUBLE AS retrieval FROM j),
x AS (SELECT query_id, {r(CLAMP.format('''retrieval * 0.22::DOUBLE + least(1.0, sources / 3.0::DOUBLE) * 0.1::DOUBLE + grounded * 0.2::DOUBLE + coverage * 0.16::DOUBLE + least(1.0, relevant / 3.0::DOUBLE) * 0.1::DOUBLE + consistency * 0.16::DOUBLE + least(1, cited) * 0.1::DOUBLE - least(1.0, conflicts / 3.0::DOUBLE) * 0.12::DOUBLE
  - (CASE WHEN relevant = 0 OR retrieval < 0.25 THEN 0.18 ELSE 0 END::DOUBLE + CASE WHEN conflicts > 0 THEN 0.16 ELSE 0 END::DOUBLE + CASE WHEN cited = 0 THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN grounded < 0.55 THEN 0.12 ELSE 0 END::DOUBLE + CASE WHEN coverage < 0.5 THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN consistency < 0.5 THEN 0.12 ELSE 0 END::DOUBLE)'''), 3)} AS confidence FROM v)
SELECT query_id, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END AS level FROM x"""
