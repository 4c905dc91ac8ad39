"""Queries that complete others: whole processed queries, diagnostics with citations, drift snapshots, token costs, series as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import understand
from ..operators.search import hybrid
from .operations import SAMPLES, r, samples
from .quality import EXPECTED, QUESTIONS, asked, cases, expected, like, sql_string
from .registry import query
from .reports import REWRITTEN, STEM_W, SYNONYM_MAP
from .retrieval import B, HYBRID, WORDS, candidates

INTENT_SQL = cases([(like(p), sql_string(n)) for n, p, _ in understand.INTENTS], sql_string("unknown"))
SURE_SQL = cases([(f"trim(t, {B}) = ''", "0"), *[(like(p), str(c)) for _, p, c in understand.INTENTS]], "0.5")


@query(rf"""WITH {QUESTIONS}, {REWRITTEN}, u AS (SELECT *, coalesce(rewritten, trim(t, {B})) AS used FROM rw), m AS (SELECT k.key AS key, k.value AS v FROM (SELECT unnest(map_entries({SYNONYM_MAP})) AS k)),
w AS (SELECT conv_id, turn, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS w FROM (SELECT *, {WORDS.format('used')} AS ws FROM u)), s AS (SELECT *, {STEM_W} AS s FROM w),
x AS (SELECT conv_id, turn, i, unnest(generate_series(1, len(v))) AS j, unnest(v) AS v FROM s JOIN m ON m.key = CASE WHEN w IN (SELECT key FROM m) THEN w ELSE s END),
d AS (SELECT conv_id, turn, v, min(i * 100 + j) AS place FROM x GROUP BY 1, 2, 3), e AS (SELECT conv_id, turn, string_agg(v, '|' ORDER BY place) AS more FROM d GROUP BY 1, 2),
k AS (SELECT u.conv_id, u.turn, md5(trim(t, {B})) AS original, md5(rewritten) AS rewritten, coalesce(more, '') AS expanded, {INTENT_SQL} AS found, CAST({SURE_SQL} AS DOUBLE) AS confidence, trim(t, {B}) = '' AS empty FROM u LEFT JOIN e ON e.conv_id = u.conv_id AND e.turn = u.turn)
SELECT conv_id, turn, original, rewritten, expanded, CASE WHEN conv_id % 4 = 0 AND NOT empty THEN 'procedural' ELSE found END AS intent, confidence FROM k""")
def processed_queries(read):
    """Everything that is made of a question before anything is searched; some callers say what they intend, in words that are known or are not."""
    given = F.when(F.col("conv_id") % 4 == 0, "procedural").when(F.col("conv_id") % 4 == 1, "no such intent")
    rows = asked(read).withColumn("p", understand.processed(F.col("t"), given))
    return rows.select("conv_id", "turn", F.md5("p.original").alias("original"), F.md5("p.rewritten").alias("rewritten"), F.array_join("p.expanded", "|").alias("expanded"), "p.intent", "p.confidence")


@query(f"""WITH {HYBRID}, z AS (SELECT query_id, list(chunk_id) FILTER (WHERE hybrid_rank <= 2) AS cited, list(chunk_id) FILTER (WHERE rank <= 5) AS returned, {r('max(score) FILTER (WHERE rank <= 5)', 3)} AS top, {r('avg(score) FILTER (WHERE rank <= 5)', 3)} AS mean,
  {r('max(score) FILTER (WHERE rank <= 5) - min(score) FILTER (WHERE rank <= 5)', 3)} AS spread, count(*) FILTER (WHERE rank <= 5 AND score >= 0.2) AS relevant, count(DISTINCT regexp_replace(chunk_id, ':[^:]*$', '')) FILTER (WHERE rank <= 5) AS diversity FROM h GROUP BY 1)
SELECT query_id, top, mean, spread, relevant, diversity, {r('len(list_intersect(cited, returned)) / greatest(1, len(cited))::DOUBLE', 3)} AS citation_coverage FROM z""")
def retrieval_diagnostics(read):
    """Scores of each question's five results, in how many sections they lie, and how many of the chunks that its answer cites, the two best mixed ones, are among them."""
    p = hybrid(candidates(read, 20))
    near = F.col("rank") <= 5
    score = F.when(near, F.col("score"))
    z = p.groupBy("query_id").agg(
        F.collect_set(F.when(F.col("hybrid_rank") <= 2, F.col("id"))).alias("cited"), F.collect_set(F.when(near, F.col("id"))).alias("returned"), tx.rounded(F.max(score), 3).alias("top"), tx.rounded(F.avg(score), 3).alias("mean"),
        tx.rounded(F.max(score) - F.min(score), 3).alias("spread"), F.count_if(near & (F.col("score") >= 0.2)).alias("relevant"), F.countDistinct(F.when(near, F.concat_ws(":", "doc_id", "section_id"))).alias("diversity"),
    )
    coverage = F.size(F.array_intersect("cited", "returned")) / F.greatest(F.lit(1), F.size("cited"))
    return z.select("query_id", "top", "mean", "spread", "relevant", "diversity", tx.rounded(coverage, 3).alias("citation_coverage"))


SNAPSHOTS = f"""{EXPECTED}, {HYBRID}, t AS (SELECT query_id, c.doc_id, min(rank) AS rank, min(hybrid_rank) AS hybrid_rank FROM h JOIN chunks c USING (chunk_id) GROUP BY 1, 2), tp AS (SELECT query_id, max(combined) AS top_score FROM h GROUP BY 1),
e AS (SELECT x.item_id AS query_id, count(*) AS wanted, count(*) FILTER (WHERE hybrid_rank <= 3) AS found, min(hybrid_rank) AS rank, coalesce(string_agg(x.doc_id::VARCHAR, ',' ORDER BY x.doc_id) FILTER (WHERE hybrid_rank IS NULL OR hybrid_rank > 3), '') AS missing,
  coalesce(string_agg(x.doc_id::VARCHAR, ',' ORDER BY x.doc_id) FILTER (WHERE hybrid_rank <= 3 AND rank > 3), '') AS added, coalesce(string_agg(x.doc_id::VARCHAR, ',' ORDER BY x.doc_id) FILTER (WHERE rank <= 3 AND hybrid_rank > 3), '') AS lost, count(*) FILTER (WHERE hybrid_rank IS NULL OR hybrid_rank > 3) AS n_missing
  FROM expected x LEFT JOIN t ON t.query_id = x.item_id AND t.doc_id = x.doc_id GROUP BY 1)"""


def snapshots(read):
    """Each question's expected documents in mixed retrieval: recall at 3, first rank, top score, and which are missing, added or lost beside dense retrieval."""
    p = hybrid(candidates(read, 20))
    t = p.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.min("hybrid_rank").alias("hybrid_rank"))
    e = expected(read).join(t, ["query_id", "doc_id"], "left")
    there, was = F.coalesce(F.col("hybrid_rank") <= 3, F.lit(False)), F.coalesce(F.col("rank") <= 3, F.lit(False))
    ids = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("doc_id")))), ",")
    g = e.groupBy("query_id").agg(
        F.count("*").alias("wanted"), F.count_if(there).alias("found"), F.min("hybrid_rank").alias("rank"), ids(~there).alias("missing"), ids(there & ~was & F.col("rank").isNotNull()).alias("added"),
        ids(was & ~there).alias("lost"), F.count_if(~there).alias("n_missing"),
    )
    return g.join(p.groupBy("query_id").agg(F.max("combined").alias("top_score")), "query_id", "left")


@query(f"WITH {SNAPSHOTS} SELECT query_id, {r('found / wanted::DOUBLE', 4)} AS recall, CAST(rank AS BIGINT) AS rank, {r('top_score', 6)} AS top_score, missing, added, lost FROM e LEFT JOIN tp USING (query_id)")
def drift_snapshots(read):
    """What a drift report compares with later: recall, rank, top score and the expected documents that are missing."""
    return snapshots(read).select("query_id", tx.rounded(F.col("found") / F.col("wanted"), 4).alias("recall"), "rank", tx.rounded(F.col("top_score"), 6).alias("top_score"), "missing", "added", "lost")


@query(f"WITH {SNAPSHOTS} SELECT count(*) AS questions, count(*) FILTER (WHERE n_missing > 0) AS incomplete, CAST(sum(n_missing) AS BIGINT) AS missing, count(*) FILTER (WHERE added <> '') AS gained, count(*) FILTER (WHERE lost <> '') AS lost, {r('avg(found / wanted::DOUBLE)', 4)} AS mean_recall FROM e")
def drift_summary(read):
    some = lambda c: F.count_if(F.col(c) != "")
    return snapshots(read).agg(
        F.count("*").alias("questions"), F.count_if(F.col("n_missing") > 0).alias("incomplete"), F.sum("n_missing").alias("missing"), some("added").alias("gained"), some("lost").alias("lost"),
        tx.rounded(F.avg(F.col("found") / F.col("wanted")), 4).alias("mean_recall"),
    )


#: Prices of a thousand tokens that are read and that are written.
IN_PRICE, OUT_PRICE = 0.0005, 0.0015
_TOKENS = "ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::BIGINT"


@query(f"""WITH t AS (SELECT conv_id, role, {_TOKENS} AS tokens FROM conversations WHERE text IS NOT NULL), c AS (SELECT conv_id, coalesce(sum(tokens) FILTER (WHERE role <> 'assistant'), 0)::BIGINT AS tokens_in, coalesce(sum(tokens) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS tokens_out FROM t GROUP BY 1)
SELECT conv_id, tokens_in, tokens_out, {r(f'tokens_in / 1000.0::DOUBLE * {IN_PRICE}::DOUBLE + tokens_out / 1000.0::DOUBLE * {OUT_PRICE}::DOUBLE', 6)} AS cost FROM c""")
def token_costs(read):
    """Estimated tokens that each conversation reads and writes, and what they cost."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    t = read("conversations").where("text is not null").select("conv_id", "role", F.ceil(words * 1.3).alias("tokens"))
    of = lambda mine: F.coalesce(F.sum(F.when(mine, F.col("tokens"))), F.lit(0))
    c = t.groupBy("conv_id").agg(of(F.col("role") != "assistant").alias("tokens_in"), of(F.col("role") == "assistant").alias("tokens_out"))
    return c.withColumn("cost", tx.rounded(F.col("tokens_in") / 1000.0 * F.lit(IN_PRICE) + F.col("tokens_out") / 1000.0 * F.lit(OUT_PRICE), 6))


@query(f"""WITH {SAMPLES} SELECT to_json({{'queue': event_type, 'succeeded': count(*) FILTER (WHERE NOT failed), 'failed': count(*) FILTER (WHERE failed), 'retrying': count(*) FILTER (WHERE k BETWEEN 3 AND 4), 'dlq': count(*) FILTER (WHERE k >= 5), 'attempts': CAST(sum(k) AS BIGINT)}})::VARCHAR AS line FROM s GROUP BY event_type""")
def metric_json(read):
    """Each queue's counts as a JSON object."""
    k = F.col("k")
    g = samples(read).groupBy(F.col("event_type").alias("queue")).agg(
        F.count_if(~F.col("failed")).alias("succeeded"), F.count_if("failed").alias("failed"), F.count_if(k.between(3, 4)).alias("retrying"), F.count_if(k >= 5).alias("dlq"), F.sum("k").alias("attempts")
    )
    return g.select(F.to_json(F.struct("queue", "succeeded", "failed", "retrying", "dlq", "attempts")).alias("line"))


@query("""WITH f AS (SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS f FROM benchmark)
SELECT item_id, len(list_distinct(list_transform(generate_series(1, length(f) - 2), lambda i: substring(f, i, 3)))) AS three, len(list_distinct(list_transform(generate_series(1, length(f) - 4), lambda i: substring(f, i, 5)))) AS five FROM f""")
def ngram_counts(read):
    """Different runs of three and of five characters of each text without white space."""
    return read("benchmark").select("item_id", F.size(tx.ngrams("text")).alias("three"), F.size(tx.ngrams("text", 5)).alias("five"))
