"""Queries over a semantic cache: what each lookup found, and how often lookups hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import semantic_cache
from .operations import SAMPLES, r, samples
from .registry import query

#: Views and clicks put, purchases and signups look up, errors of kind 9 invalidate an index. Versions and contexts go by kind and user.
REQUESTS_SQL = f"""{SAMPLES}, n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, embedding::DOUBLE[] AS embedding FROM embeddings),
q AS (SELECT event_id AS request_id, epoch_ms(ts) AS at_ms, user_id % 20 AS index_id, CASE WHEN event_type IN ('view', 'click') THEN 'put' WHEN event_type = 'error' THEN 'invalidate' ELSE 'lookup' END AS op,
  CASE WHEN event_type <> 'error' THEN 'v' || k % 2 END AS version, sha256('user ' || user_id % 3) AS context, 'query ' || event_id % least(n, 40) AS query, event_id % least(n, 40) AS place,
  CASE WHEN k = 7 THEN 60000000 ELSE 7200000000 END AS ttl_ms, CASE WHEN k = 3 THEN 0.95::DOUBLE ELSE 0.92 END AS threshold FROM s, n WHERE event_type <> 'error' OR k = 9),
e AS (SELECT q.*, embedding, count(*) FILTER (WHERE op = 'put') OVER w AS puts, count(*) FILTER (WHERE op = 'invalidate') OVER w AS wipes,
  substr(sha256(query || '::' || index_id || '::' || context || '::' || version), 1, 24) AS cache_key FROM q JOIN v USING (place) WINDOW w AS (PARTITION BY index_id ORDER BY at_ms, request_id ROWS UNBOUNDED PRECEDING))"""


def requests(read) -> DataFrame:
    """Cache requests from events: each of one of forty vectors."""
    vectors = read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy("vec_id").limit(40)
    places = vectors.select(F.collect_list(F.struct("vec_id", "embedding")).alias("vs")).select(F.transform(F.array_sort("vs"), lambda v: v["embedding"]).alias("vs"))  # one row of forty
    kind, k = F.col("event_type"), F.col("k")
    place = F.col("event_id") % F.size("vs")
    rows = samples(read).where((kind != "error") | (k == 9)).join(F.broadcast(places), F.lit(True)).where(F.size("vs") > 0)
    return rows.select(
        F.col("event_id").alias("request_id"), F.unix_millis("ts").alias("at_ms"), (F.col("user_id") % 20).alias("index_id"),
        F.when(kind.isin("view", "click"), "put").when(kind == "error", "invalidate").otherwise("lookup").alias("op"),
        F.when(kind != "error", F.concat(F.lit("v"), (k % 2).cast("string"))).alias("version"), F.concat(F.lit("user "), (F.col("user_id") % 3).cast("string")).alias("context"),
        F.concat(F.lit("query "), place.cast("string")).alias("query"), F.get("vs", place.cast("int")).alias("embedding"),
        F.when(k == 7, F.lit(60_000_000)).otherwise(F.lit(7_200_000_000)).cast("bigint").alias("ttl_ms"), F.when(k == 3, 0.95).otherwise(0.92).alias("threshold"),
    )


LOOKUPS_SQL = f"""WITH {REQUESTS_SQL},
h AS (SELECT l.request_id, l.index_id, l.threshold, p.request_id AS entry_id, p.cache_key, p.puts,
  CASE WHEN l.at_ms - p.at_ms <= p.ttl_ms AND l.version = p.version AND l.context = p.context THEN list_cosine_similarity(l.embedding, p.embedding) END AS similarity
  FROM e l LEFT JOIN e p ON l.index_id = p.index_id AND p.op = 'put' AND p.puts <= l.puts AND p.puts > l.puts - 100 AND p.wipes = l.wipes WHERE l.op = 'lookup'),
t AS (SELECT request_id, any_value(index_id) AS index_id, any_value(threshold) AS threshold, count(entry_id) AS n, max(similarity) AS similarity,
  arg_max(entry_id, (similarity, puts)) FILTER (WHERE similarity IS NOT NULL) AS entry_id, arg_max(cache_key, (similarity, puts)) FILTER (WHERE similarity IS NOT NULL) AS cache_key FROM h GROUP BY 1),
looked AS (SELECT request_id, index_id, coalesce(similarity >= threshold, false) AS hit, entry_id, cache_key, {r("similarity", 6)} AS similarity, threshold,
  CASE WHEN n = 0 THEN 'no-cache-entries-for-index' WHEN similarity IS NULL THEN 'no-context-match' WHEN similarity >= threshold THEN 'semantic-context-hit' ELSE 'below-threshold' END AS reason FROM t)"""


@query(f"{LOOKUPS_SQL} SELECT * FROM looked")
def semantic_cache_lookups(read):
    """What each lookup finds in its index's cache at that moment: entries expire, are pushed out by newer ones, and are of a version and a context."""
    return semantic_cache.lookups(requests(read)).withColumn("similarity", tx.rounded(F.col("similarity"), 6))


@query(f"{LOOKUPS_SQL} SELECT index_id, reason, count(*) AS n, {r('count(*) FILTER (WHERE hit) / count(*)::DOUBLE', 4)} AS hit_rate FROM looked GROUP BY GROUPING SETS ((index_id, reason), (index_id), ())")
def semantic_cache_rates(read):
    """Lookups and hits by index and reason, with totals."""
    looked = semantic_cache.lookups(requests(read))
    sets = looked.groupingSets([["index_id", "reason"], ["index_id"], []], "index_id", "reason")
    return sets.agg(F.count("*").alias("n"), tx.rounded(F.count_if("hit") / F.count("*"), 4).alias("hit_rate"))


@query(f"""WITH {REQUESTS_SQL}, m AS (SELECT index_id, max(puts) AS last, max(wipes) AS wipes, max(at_ms) AS now FROM e GROUP BY 1)
SELECT e.index_id, version, count(*) AS stored, count(*) FILTER (WHERE e.wipes < m.wipes) AS invalidated, count(*) FILTER (WHERE e.wipes = m.wipes AND puts <= last - 100) AS evicted,
  count(*) FILTER (WHERE e.wipes = m.wipes AND puts > last - 100 AND now - at_ms > ttl_ms) AS expired, count(*) FILTER (WHERE e.wipes = m.wipes AND puts > last - 100 AND now - at_ms <= ttl_ms) AS live
FROM e JOIN m USING (index_id) WHERE op = 'put' GROUP BY 1, 2""")
def semantic_cache_contents(read):
    """What became of the entries of each index and version by the index's last request."""
    rows = semantic_cache.numbered(requests(read).drop("embedding"))
    last = rows.groupBy("index_id").agg(F.max("puts").alias("last"), F.max("wipes").alias("all_wipes"), F.max("at_ms").alias("now"))
    wiped, pushed = F.col("wipes") < F.col("all_wipes"), F.col("puts") <= F.col("last") - semantic_cache.MOST_ENTRIES
    old = F.col("now") - F.col("at_ms") > F.col("ttl_ms")
    return rows.where("op = 'put'").join(last, "index_id").groupBy("index_id", "version").agg(
        F.count("*").alias("stored"), F.count_if(wiped).alias("invalidated"), F.count_if(~wiped & pushed).alias("evicted"), F.count_if(~wiped & ~pushed & old).alias("expired"), F.count_if(~wiped & ~pushed & ~old).alias("live"),
    )
