"""Queries that compare replays and variants of answering, question by question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as tx
from ..operators import comparison
from ..operators.search import hybrid
from ..session import checkpointed
from .operations import r
from .quality import ANSWERED, EXPECTED, FAITH, RELEVANCE, W3, expected
from .registry import query
from .retrieval import HYBRID, candidates

REFUSAL = "The retrieved context does not contain an answer."
BASELINE = "concise"
#: What a variant's answer is made of; the strict one refuses below a score of 0.3, the dense one takes the nearest chunk instead of the best mixed one.
VARIANTS = ("citation", "concise", "dense", "strict")
#: Estimated milliseconds a candidate and a letter take, and the price of a token.
PER_CANDIDATE, PER_LETTER, PRICE = 0.5, 0.01, 0.000002

RUNS_SQL = f"""{EXPECTED}, {HYBRID}, p AS (SELECT h.*, c.doc_id, q.text AS question FROM h JOIN chunks c USING (chunk_id) JOIN benchmark q ON q.item_id = h.query_id),
wa AS (SELECT item_id AS query_id, list(DISTINCT doc_id) AS wanted FROM expected GROUP BY 1),
fo AS (SELECT query_id, list(DISTINCT doc_id) FILTER (WHERE rank <= 3) AS near, list(DISTINCT doc_id) FILTER (WHERE hybrid_rank <= 3) AS mixed FROM p GROUP BY 1),
b AS (SELECT query_id, any_value(question) AS question, max(text) FILTER (WHERE rank = 1) AS near, max(text) FILTER (WHERE hybrid_rank = 1) AS mixed, max(chunk_id) FILTER (WHERE hybrid_rank = 1) AS id, max(combined) FILTER (WHERE hybrid_rank = 1) AS top FROM p GROUP BY 1),
v AS (SELECT query_id, question, id, top, unnest(['citation', 'concise', 'dense', 'strict']) AS variant, near, mixed FROM b),
w AS (SELECT query_id, question, variant, CASE WHEN variant = 'dense' THEN near ELSE mixed END AS context, CASE variant WHEN 'concise' THEN 'Based on the retrieved context: ' || mixed WHEN 'citation' THEN 'Based on the retrieved context: ' || mixed || ' Source: ' || id || '.'
  WHEN 'dense' THEN near ELSE CASE WHEN top < 0.3 THEN '{REFUSAL}' ELSE mixed END END AS answer FROM v),
x AS (WITH a AS (SELECT query_id, variant, context AS question, answer FROM w){FAITH[len(ANSWERED):]} SELECT query_id, variant, faithfulness FROM faith),
y AS (WITH a AS (SELECT query_id, variant, question, answer FROM w){RELEVANCE[len(ANSWERED):]} SELECT query_id, variant, relevance FROM rel),
z AS (SELECT w.query_id, w.variant, answer, faithfulness, relevance, {r("CASE WHEN wanted IS NULL THEN 1.0 ELSE len(list_intersect(wanted, CASE WHEN w.variant = 'dense' THEN fo.near ELSE fo.mixed END)) / len(wanted) END", 3)} AS recall,
  {r(f"len(list_intersect({W3.format('answer')}, {W3.format('context')})) / greatest(len({W3.format('answer')}), 1)::DOUBLE", 3)} AS groundedness, CASE WHEN w.variant = 'dense' THEN 5 ELSE 20 END * {PER_CANDIDATE}::DOUBLE + {PER_LETTER}::DOUBLE * length(answer) AS latency_ms,
  ceil(len(regexp_split_to_array(trim(regexp_replace(answer, '\\s+', ' ', 'g')), ' ')) * 1.3::DOUBLE) * {PRICE}::DOUBLE AS cost_usd, answer = '{REFUSAL}' AS refused FROM w JOIN x USING (query_id, variant) JOIN y USING (query_id, variant) JOIN fo USING (query_id) LEFT JOIN wa USING (query_id)),
runs AS (SELECT *, {r('0.4::DOUBLE * faithfulness + 0.4::DOUBLE * relevance + 0.2::DOUBLE * recall', 4)} AS quality FROM z)"""


def runs(read) -> DataFrame:
    """Every variant crossed with every question: RUN rows."""
    p = hybrid(candidates(read, 20))
    docs = lambda rank: F.collect_set(F.when(F.col(rank) <= 3, F.col("doc_id")))  # noqa: E731  three at most
    best = lambda c, rank: F.max(F.when(F.col(rank) == 1, F.col(c)))
    b = p.groupBy("query_id").agg(
        F.first("question").alias("question"), best("text", "rank").alias("near"), best("text", "hybrid_rank").alias("mixed"), best("id", "hybrid_rank").alias("id"), best("combined", "hybrid_rank").alias("top"),
        docs("rank").alias("near_docs"), docs("hybrid_rank").alias("mixed_docs"),
    )
    wanted = expected(read).groupBy("query_id").agg(F.collect_set("doc_id").alias("wanted"))
    v = b.join(wanted, "query_id", "left").withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    is_dense, based = F.col("variant") == "dense", F.concat(F.lit("Based on the retrieved context: "), "mixed")
    answer = F.when(F.col("variant") == "concise", based).when(F.col("variant") == "citation", F.concat(based, F.lit(" Source: "), "id", F.lit("."))).when(is_dense, F.col("near"))
    answer = answer.when(F.col("top") < 0.3, REFUSAL).otherwise(F.col("mixed"))
    v = v.select("query_id", "variant", "question", "wanted", F.when(is_dense, F.col("near")).otherwise(F.col("mixed")).alias("context"), F.when(is_dense, F.col("near_docs")).otherwise(F.col("mixed_docs")).alias("docs"), answer.alias("answer"))
    a, c = F.col("answer"), F.col("context")
    said, there = F.array_distinct(tx.keywords(a)), F.array_distinct(tx.keywords(c))
    recall = F.when(F.size("wanted") > 0, F.size(F.array_intersect("wanted", "docs")) / F.size("wanted")).otherwise(F.lit(1.0))
    z = v.select(
        "variant", "query_id", "answer", scoring.faithfulness(a, c).alias("faithfulness"), scoring.relevance(F.col("question"), a).alias("relevance"), tx.rounded(recall, 3).alias("recall"),
        tx.rounded(F.size(F.array_intersect(said, there)) / F.greatest(F.size(said), F.lit(1)), 3).alias("groundedness"),
        (F.when(is_dense, 5).otherwise(20) * F.lit(PER_CANDIDATE) + F.lit(PER_LETTER) * F.length(a)).alias("latency_ms"),
        (F.ceil(F.size(F.split(tx.collapsed(a), " ")) * 1.3).cast("double") * F.lit(PRICE)).alias("cost_usd"), (a == REFUSAL).alias("refused"),
    )
    return z.withColumn("quality", tx.rounded(0.4 * F.col("faithfulness") + 0.4 * F.col("relevance") + 0.2 * F.col("recall"), 4))


AVERAGES = ("faithfulness", "relevance", "recall", "groundedness", "quality", "latency_ms")
METRICS_SQL = f"""{RUNS_SQL}, metrics AS (SELECT variant, count(*) AS n, {", ".join(f"sum(CAST(round({c} * 1000000) AS BIGINT))::DOUBLE / (1000000 * count(*)) AS avg_{c}" for c in (*AVERAGES, "cost_usd"))}, avg(CASE WHEN refused THEN 1.0::DOUBLE ELSE 0.0 END) AS refusal_rate FROM runs GROUP BY 1)"""


@query(f"WITH {METRICS_SQL} SELECT variant, n, {', '.join(f'{r(f'avg_{c}', 4)} AS avg_{c}' for c in AVERAGES)}, {r('avg_cost_usd', 6)} AS avg_cost_usd, {r('refusal_rate', 4)} AS refusal_rate FROM metrics")
def variant_metrics(read):
    """Each variant's means over all questions, and how often it refuses."""
    m = comparison.variant_metrics(runs(read))
    return m.select("variant", "n", *[tx.rounded(F.col(f"avg_{c}"), 4).alias(f"avg_{c}") for c in AVERAGES], tx.rounded(F.col("avg_cost_usd"), 6).alias("avg_cost_usd"), tx.rounded(F.col("refusal_rate"), 4).alias("refusal_rate"))


def listed(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


_BAD = (("groundedness", "g < -0.02"), ("recall", "rc < -0.01"), ("latency", "l > greatest(1.0, bl * 0.05)"), ("cost", "co > greatest(0.000001::DOUBLE, bc * 0.1)"), ("refusals", "rf > 0.01"),
        ("answers", "rate > 0.4 AND NOT (q > 0.02 OR g > 0.02 OR rc > 0.02)"))
_GOOD = (("groundedness", "g > 0.02"), ("recall", "rc > 0.01"), ("latency", "l < -greatest(1.0, bl * 0.05)"), ("cost", "co < -greatest(0.000001::DOUBLE, bc * 0.1)"), ("refusals", "rf < -0.01"), ("quality", "q > 0.02"))


@query(f"""WITH {METRICS_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY avg_quality DESC, variant <> '{BASELINE}', variant) AS place FROM metrics),
c AS (SELECT * FROM placed WHERE variant <> '{BASELINE}' ORDER BY place LIMIT 1), ba AS (SELECT * FROM placed WHERE variant = '{BASELINE}'), wi AS (SELECT variant AS winner FROM placed WHERE place = 1),
plain AS (SELECT *, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS said FROM runs),
ch AS (SELECT {r('count(*) FILTER (WHERE n.said <> coalesce(o.said, chr(0))) / greatest(count(*), 1)::DOUBLE', 4)} AS rate FROM plain n JOIN c ON n.variant = c.variant LEFT JOIN plain o ON o.variant = '{BASELINE}' AND o.query_id = n.query_id),
d AS (SELECT ba.variant AS baseline, c.variant AS candidate, winner, rate, c.avg_groundedness - ba.avg_groundedness AS g, c.avg_recall - ba.avg_recall AS rc, c.avg_latency_ms - ba.avg_latency_ms AS l, ba.avg_latency_ms AS bl, c.avg_cost_usd - ba.avg_cost_usd AS co, ba.avg_cost_usd AS bc,
  c.refusal_rate - ba.refusal_rate AS rf, c.avg_quality - ba.avg_quality AS q FROM c, ba, wi, ch), j AS (SELECT *, {listed(_BAD)} AS bad, {listed(_GOOD)} AS good FROM d)
SELECT baseline, candidate, winner, rate AS response_change_rate, array_to_string(bad, ',') AS regressions, array_to_string(good, ',') AS improvements, CASE WHEN len(bad) > 0 THEN 'block' WHEN winner = candidate AND len(good) > 0 THEN 'promote' ELSE 'manual_review' END AS recommendation FROM j""")
def variant_decision(read):
    """Whether the best other variant may take the baseline's place."""
    found = comparison.decision(checkpointed(runs(read)), BASELINE)
    return found.withColumns({c: F.array_join(c, ",") for c in ("regressions", "improvements")})


@query(f"""WITH {RUNS_SQL}, plain AS (SELECT *, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS said FROM runs),
d AS (SELECT n.query_id, n.said <> o.said AS response_changed, {listed((('groundedness_drop', 'n.groundedness < o.groundedness - 0.02'), ('recall_drop', 'n.recall < o.recall - 0.01'), ('cost_increase', 'n.cost_usd > o.cost_usd'), ('latency_increase', 'n.latency_ms > o.latency_ms + 1'), ('new_refusal', 'n.refused AND NOT o.refused')))} AS reasons
  FROM plain n JOIN plain o ON o.query_id = n.query_id WHERE n.variant = 'strict' AND o.variant = '{BASELINE}')
SELECT query_id, response_changed, array_to_string(reasons, ',') AS reasons FROM d WHERE response_changed OR len(reasons) > 0""")
def variant_affected(read):
    """Questions that the strict variant answers otherwise or worse than the baseline, and in what."""
    return comparison.affected(checkpointed(runs(read)), BASELINE, "strict").withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {HYBRID}, b AS (SELECT query_id, chunk_id, rank, score, rank AS was FROM h WHERE rank <= 5), n AS (SELECT query_id, chunk_id, hybrid_rank AS rank, combined AS score, rank AS was FROM h WHERE hybrid_rank <= 5),
j AS (SELECT coalesce(b.query_id, n.query_id) AS query_id, coalesce(b.chunk_id, n.chunk_id) AS id, b.rank AS before, n.rank AS after, {r('n.score - b.score', 3)} AS delta FROM b FULL JOIN n ON b.query_id = n.query_id AND b.chunk_id = n.chunk_id),
t AS (SELECT query_id, max(text) FILTER (WHERE rank = 1) AS a, max(text) FILTER (WHERE hybrid_rank = 1) AS z, max(score) FILTER (WHERE rank = 1) >= 0.3 AS ga, max(combined) FILTER (WHERE hybrid_rank = 1) >= 0.3 AS gz,
  string_agg(rank || '>' || hybrid_rank, ',' ORDER BY hybrid_rank) FILTER (WHERE hybrid_rank <= 5) AS moves FROM h GROUP BY 1),
g AS (SELECT query_id, coalesce(string_agg(id, ',' ORDER BY after) FILTER (WHERE before IS NULL), '') AS added, coalesce(string_agg(id, ',' ORDER BY before) FILTER (WHERE after IS NULL), '') AS removed, coalesce(string_agg(id, ',' ORDER BY before) FILTER (WHERE before <> after), '') AS reordered,
  coalesce(string_agg(id || ':' || round(delta * 1000)::BIGINT, ',' ORDER BY before) FILTER (WHERE delta <> 0), '') AS score_deltas, count(*) FILTER (WHERE before IS DISTINCT FROM after OR delta <> 0) > 0 AS moved FROM j GROUP BY 1)
SELECT query_id, added, removed, reordered, score_deltas, moves <> '1>1,2>2,3>3,4>4,5>5' AS reranking_changed, trim(regexp_replace(a, '\\s+', ' ', 'g')) <> trim(regexp_replace(z, '\\s+', ' ', 'g')) AS response_changed, moved OR moves <> '1>1,2>2,3>3,4>4,5>5' AS retrieval_changed,
  ga <> gz AS groundedness_changed, {r(f"{PER_LETTER}::DOUBLE * (length(z) - length(a))", 3)} AS latency_delta, CASE WHEN moved OR moves <> '1>1,2>2,3>3,4>4,5>5' OR trim(regexp_replace(a, '\\s+', ' ', 'g')) <> trim(regexp_replace(z, '\\s+', ' ', 'g')) OR ga <> gz THEN 'diverged' ELSE 'matched' END AS status FROM g JOIN t USING (query_id)""")
def replay_comparison(read):
    """The original run of each question, dense, against its replay, mixed: chunks, order, scores, reranking, answer and groundedness, part by part."""
    p = hybrid(candidates(read, 20))

    def snapshot(rank: str, score: str, before: str) -> DataFrame:
        top = F.col(rank) <= 5
        chunk = F.when(top, F.struct(F.col("id").alias("chunk_id"), F.col(rank).cast("int").alias("rank"), F.col(score).alias("score")))
        move = F.when(top, F.struct(F.col("id").alias("chunk_id"), F.col(before).cast("int").alias("before"), F.col(rank).cast("int").alias("after")))
        first = lambda c: F.max(F.when(F.col(rank) == 1, c))
        by_place = lambda c, place: F.array_sort(F.collect_list(c), lambda x, y: x[place] - y[place])  # noqa: E731  five at most
        rows = p.groupBy(F.col("query_id").alias("id")).agg(
            by_place(chunk, "rank").alias("chunks"), by_place(move, "after").alias("moves"), first(F.col("text")).alias("answer"), first(F.col(score) >= 0.3).alias("grounded")
        )
        reranking = F.transform("moves", lambda m: F.struct(m["chunk_id"].alias("chunk_id"), m["before"].alias("before"), m["after"].alias("after"), F.lit(0.0).alias("score")))
        return rows.select(
            "id", "chunks", F.transform(reranking, lambda m: F.struct(F.lit(None).cast("string").alias("chunk_id"), m["before"].alias("before"), m["after"].alias("after"), m["score"].alias("score"))).alias("reranking"),
            "answer", "grounded", F.lit("extractive").alias("model"), F.lit("local").alias("provider"), F.lit("lexical").alias("embedding"), F.lit(0.0).alias("cost_usd"), (F.lit(PER_LETTER) * F.length("answer")).alias("latency_ms"),
        )

    c = comparison.compare_snapshots(snapshot("rank", "score", "rank"), snapshot("hybrid_rank", "combined", "rank"))
    told = F.array_join(F.transform("score_deltas", lambda d: F.concat(d["chunk_id"], F.lit(":"), F.round(d["delta"] * 1000).cast("bigint").cast("string"))), ",")
    lists = {k: F.array_join(k, ",") for k in ("added", "removed", "reordered")}
    return c.withColumns(lists | {"score_deltas": told}).select(
        F.col("id").alias("query_id"), "added", "removed", "reordered", "score_deltas", "reranking_changed", "response_changed", "retrieval_changed", "groundedness_changed", "latency_delta", "status"
    )
