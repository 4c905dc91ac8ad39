"""Queries for the smaller operators: vectors of other kinds, filters, costs, cache upkeep, experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dead_letters
from ..operators.embedding import embedding_map, lexical, quantised, signed_hash
from ..operators.search import topk
from .operations import SAMPLES, r, samples
from .registry import query
from .retrieval import DENSE, MAP_SQL, NEAR_QUESTION, STEM, VECTOR_SCORES, all_chunks, dense, guesses, questions, shadow, vectors_of


@query(f"""WITH c AS (SELECT item_id, unnest(string_split(lower(text), '')) AS c, unnest(generate_series(0, length(lower(text)) - 1)) AS i FROM benchmark),
b AS (SELECT item_id, (ord(c) + 31 * i) % 16 AS bucket, sum(((ord(c) % 37) + 1) / 37.0::DOUBLE) AS w FROM c GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM b GROUP BY 1)
SELECT item_id, bucket, {r('w / n', 6)} AS x FROM b JOIN n USING (item_id)""")
def embed_positions(read):
    """Sixteen buckets by letter and place, scaled to length 1."""
    c = read("benchmark").select("item_id", F.posexplode(F.split(F.lower(tx.nfkc("text")), "")).alias("i", "c")).withColumn("o", F.ascii("c"))
    b = c.groupBy("item_id", ((F.col("o") + 31 * F.col("i")) % 16).alias("bucket")).agg(F.sum((F.col("o") % 37 + 1) / 37.0).alias("w"))
    n = b.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return b.join(n, "item_id").select("item_id", "bucket", tx.rounded(F.col("w") / F.col("n"), 6).alias("x"))


FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))"


@query(f"""WITH s AS (SELECT item_id, list_transform(regexp_extract_all(lower(left(text, 12000)), '[\\p{{L}}\\p{{N}}]+'), lambda w: {STEM}) AS s FROM benchmark),
f AS (SELECT item_id, unnest(s) AS f, 1.0::DOUBLE AS w FROM s UNION ALL SELECT item_id, unnest(list_transform(generate_series(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 1])), 0.75 FROM s WHERE len(s) > 1),
g AS (SELECT item_id, {FNV.format('f')} % 256 AS bucket, CASE WHEN {FNV.format("'sign:' || f")} % 2 = 0 THEN w ELSE -w END AS w FROM f)
SELECT item_id, bucket, sum(w) AS x FROM g GROUP BY 1, 2""")
def embed_signed(read):
    """Signed counts of stems and pairs in 256 buckets, before scaling."""
    f = read("benchmark").select("item_id", F.explode(signed_hash(F.col("text"))).alias("f"))
    return f.groupBy("item_id", F.col("f.bucket").alias("bucket")).agg(F.sum("f.weight").alias("x"))


@query("SELECT doc_id, contains(lower(text), 'the')::INT::BIGINT AS the, contains(lower(text), 'und')::INT::BIGINT AS und, contains(lower(text), 'les')::INT::BIGINT AS les FROM documents WHERE text IS NOT NULL")
def embed_keywords(read):
    d = read("documents").where("text is not null")
    return d.select("doc_id", *[F.lower("text").contains(k).cast("bigint").alias(k) for k in ("the", "und", "les")])


@query("SELECT doc_id, n_chars FROM documents WHERE source IS NOT DISTINCT FROM 'src0' AND lang IS NOT DISTINCT FROM 'en'")
def owned_documents(read):
    """What one tenant's user may see; a null attribute equals only null."""
    return read("documents").where(F.col("source").eqNullSafe("src0") & F.col("lang").eqNullSafe("en")).select("doc_id", "n_chars")


@query("SELECT p_partkey, p_brand FROM part WHERE (contains(lower(p_name), 'e') OR contains(lower(p_type), 'steel') OR contains(lower(p_brand), '3')) AND p_size >= 10")
def substring_search(read):
    hit = F.lower("p_name").contains("e") | F.lower("p_type").contains("steel") | F.lower("p_brand").contains("3")
    return read("part").where(hit & (F.col("p_size") >= 10)).select("p_partkey", "p_brand")


@query(f"""WITH {SAMPLES} SELECT user_id, max_by(event_id, (epoch_us(ts), event_id)) AS event_id FROM s WHERE failed AND k >= 3 GROUP BY 1""")
def trace_lookup(read):
    """Each session's newest trace that fits all conditions."""
    found = samples(read).where(F.col("failed") & (F.col("k") >= 3))
    return found.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


PRICES = (("click", 0.002), ("purchase", 0.03), ("signup", 0.01), ("view", 0.0005))


@query(f"""WITH {SAMPLES}, p(event_type, price) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in PRICES)})
SELECT event_id, CASE WHEN value > 0 THEN value ELSE 0 END AS units, coalesce(price, 0) AS price, {r('CASE WHEN value > 0 THEN value ELSE 0 END * coalesce(price, 0)', 6)} AS total FROM s LEFT JOIN p USING (event_type)""")
def cost_events(read):
    """Units and prices by kind; what is not positive or has no price costs nothing."""
    s = samples(read)
    prices = F.create_map(*[x for k, v in PRICES for x in (F.lit(k), F.lit(v))])
    units, price = F.when(F.col("value") > 0, F.col("value")).otherwise(0.0), F.coalesce(prices[F.col("event_type")], F.lit(0.0))
    return s.select("event_id", units.alias("units"), price.alias("price"), tx.rounded(units * price, 6).alias("total"))


@query(f"""WITH {SAMPLES} SELECT user_id AS index_id, count(*) FILTER (WHERE k <> 3) AS kept, count(*) FILTER (WHERE k = 3) AS evicted FROM s GROUP BY 1""")
def cache_invalidate(read):
    """Entries of one version go."""
    return samples(read).groupBy(F.col("user_id").alias("index_id")).agg(F.count_if(F.col("k") != 3).alias("kept"), F.count_if(F.col("k") == 3).alias("evicted"))


@query(f"""WITH {SAMPLES} SELECT event_type, count(*) AS lookups, {r("count(*) FILTER (WHERE k >= 5) / greatest(1, count(*))::DOUBLE", 4)} AS hit_rate, {r("count(*) FILTER (WHERE k >= 7) / greatest(1, count(*) FILTER (WHERE k >= 5))::DOUBLE", 4)} AS quality FROM s GROUP BY 1""")
def cache_metrics(read):
    hits, agreed = F.count_if(F.col("k") >= 5), F.count_if(F.col("k") >= 7)
    return samples(read).groupBy("event_type").agg(
        F.count("*").alias("lookups"), tx.rounded(hits / F.greatest(F.lit(1), F.count("*")), 4).alias("hit_rate"), tx.rounded(agreed / F.greatest(F.lit(1), hits), 4).alias("quality")
    )


def coarse(read, levels: int):
    q = vectors_of(read).select("id", quantised(F.col("v"), levels)["codes"].cast("array<double>").alias("v"))
    return topk(q.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv")), q, 5, digits=6)


def exact(read):
    v = vectors_of(read)
    return topk(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv")), v.select("id", "v"), 5, digits=6)



@query(f"WITH {DENSE}, {NEAR_QUESTION} SELECT query_id, cached, similarity, overlap, overlap >= 0.66 AS agrees, CASE WHEN overlap >= 0.75 THEN 'high' WHEN overlap >= 0.45 THEN 'medium' ELSE 'low' END AS label FROM shadow")
def shadow_evaluation(read):
    """How far the results that the nearest other question has in a cache agree with each question's fresh ones."""
    share = F.col("overlap")
    label = F.when(share >= 0.75, "high").when(share >= 0.45, "medium").otherwise("low")
    return shadow(read).select("query_id", "cached", "similarity", "overlap", (share >= 0.66).alias("agrees"), label.alias("label"))


@query()
def quantisation_experiment(read):
    """Recall at 1 and bytes of the vectors by precision."""
    best = exact(read).where("rank = 1").select("query_id", F.col("id").alias("want"))
    size = vectors_of(read).agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("cells"), F.sum(F.floor(F.size("v") / 2) + 1).alias("pairs"))
    bytes_of = {"fp32": F.col("cells") * 4, "int8": F.col("cells") + 8 * F.col("n"), "int4": F.col("pairs") + 8 * F.col("n")}
    out = None
    for name, found in (("fp32", exact(read)), ("int8", coarse(read, 127)), ("int4", coarse(read, 7))):
        hit = best.join(found.where("rank = 1"), "query_id").agg(tx.rounded(F.avg((F.col("want") == F.col("id")).cast("double")), 4).alias("recall_at_1")).withColumn("precision", F.lit(name))
        row = hit.join(size.select(F.lit(name).alias("precision"), bytes_of[name].cast("bigint").alias("bytes")), "precision")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def hyde_delta(read):
    """What a hypothetical answer in place of the question changes in the best score."""
    vectors = all_chunks(read).select(F.col("chunk_id").alias("id"), lexical(F.col("text")).alias("v"))
    after = topk(guesses(questions(read)), vectors, 1, digits=6).select("query_id", F.col("score").alias("after"))
    before = dense(read, 1).select("query_id", F.col("score").alias("before"))
    return before.join(after, "query_id").select("query_id", "before", "after", tx.rounded(F.col("after") - F.col("before"), 6).alias("change"))


#: Attempts that jobs of a kind have; jobs of other kinds cannot be queued again.
ATTEMPTS = {"click": 4, "purchase": 5, "view": 3}
REDRIVEN_SQL = f"""{SAMPLES}, policy(job_type, most) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in ATTEMPTS.items())}),
dead AS (SELECT event_id, event_type AS job_type, k AS attempts, value, most FROM s LEFT JOIN policy ON event_type = job_type WHERE k >= coalesce(most, 6)),
tried AS (SELECT *, CASE WHEN most IS NULL THEN 'no retry policy for ' || job_type WHEN value IS NULL OR value < 20 THEN 'payload not valid' WHEN attempts > 2 * most THEN 'driven again too often' END AS refused FROM dead),
redriven AS (SELECT event_id, job_type, attempts, CASE WHEN job_type = 'view' AND attempts = 3 THEN 'dry-run' WHEN refused IS NOT NULL THEN 'failed' ELSE 'scheduled' END AS status, refused FROM tried)"""


def redriven(read) -> DataFrame:
    """Dead jobs, whose attempts are used up, driven again; views at their first chance are only looked at."""
    kind = F.col("job_type")
    most = F.create_map(*[x for k, v in ATTEMPTS.items() for x in (F.lit(k), F.lit(v))])[kind]
    jobs = samples(read).select("event_id", F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("job_type"), F.col("k").alias("attempts"), "value").withColumn("most", most)
    dead = jobs.where(F.col("attempts") >= F.coalesce("most", F.lit(6))).withColumn("payload", F.col("value").cast("string"))
    refused = (
        F.when(F.col("most").isNull(), F.concat(F.lit("no retry policy for "), kind)).when(F.col("value").isNull() | (F.col("value") < 20), "payload not valid")
        .when(F.col("attempts") > 2 * F.col("most"), "driven again too often")
    )
    return dead_letters.outcomes(dead, refused, dry=(kind == "view") & (F.col("attempts") == 3))


@query(f"""WITH {REDRIVEN_SQL} SELECT event_id, job_type, status, CASE WHEN status = 'dry-run' THEN coalesce('would fail: ' || refused, 'validation passed') ELSE refused END AS reason,
  CASE status WHEN 'failed' THEN attempts + 1 WHEN 'dry-run' THEN attempts END AS attempts_after, CASE WHEN status = 'scheduled' THEN substr(sha256(event_id || ':' || attempts), 1, 16) END AS new_job_id FROM redriven""")
def dlq_outcomes(read):
    """What driving each dead job again comes to: the audit's rows, and the attempts of those that stay."""
    return redriven(read).select("event_id", "job_type", "status", "reason", F.col("attempts_after").cast("bigint").alias("attempts_after"), "new_job_id")


@query(f"""WITH {REDRIVEN_SQL} SELECT job_type, count(*) AS total, count(*) FILTER (WHERE status = 'scheduled') AS scheduled, count(*) FILTER (WHERE status = 'dry-run') AS dry_run,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status <> 'scheduled') AS still_dead FROM redriven GROUP BY ROLLUP (job_type)""")
def dlq_redrive(read):
    """The tries' history by job type and in all, and how many jobs are dead after them."""
    of = lambda s: F.count_if(F.col("status") == s)
    return redriven(read).rollup("job_type").agg(
        F.count("*").alias("total"), of("scheduled").alias("scheduled"), of("dry-run").alias("dry_run"), of("failed").alias("failed"), F.count("attempts_after").alias("still_dead")
    )


@query("""SELECT conv_id, 'session_' || regexp_replace(role || '/' || conv_id, '[^A-Za-z0-9_-]', '_', 'g') AS file, count(*) AS entries, max(turn) AS newest FROM conversations GROUP BY conv_id, role""")
def session_files(read):
    name = F.concat(F.lit("session_"), F.regexp_replace(F.concat_ws("/", "role", F.col("conv_id").cast("string")), "[^A-Za-z0-9_-]", "_"))
    return read("conversations").groupBy("conv_id", "role").agg(F.count("*").alias("entries"), F.max("turn").alias("newest")).select("conv_id", name.alias("file"), "entries", "newest")


@query("""SELECT p.page_id, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS host, list_last(string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/')) AS base, length(html) AS chars, sha256(html)[1:16] AS checksum FROM pages p""")
def page_names(read):
    """Host, last part of the path and checksum prefix of each page."""
    path = F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1)
    return read("pages").select("page_id", F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("host"), F.element_at(F.split(path, "/"), -1).alias("base"), F.length("html").alias("chars"), F.substring(F.sha2("html", 256), 1, 16).alias("checksum"))


@query(f"""WITH {VECTOR_SCORES}, w AS (SELECT * FROM ranked WHERE rank <= 5) SELECT query_id, count(*) AS n, max(score) AS top, {r('avg(score)', 3)} AS mean, {r('max(score) - min(score)', 3)} AS spread, {r('count(*) FILTER (WHERE score >= 0.2) / count(*)::DOUBLE', 3)} AS ratio FROM w GROUP BY 1""")
def routing_signals(read):
    """What routing after retrieval looks at."""
    return exact(read).groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("score").alias("top"), tx.rounded(F.avg("score"), 3).alias("mean"),
        tx.rounded(F.max("score") - F.min("score"), 3).alias("spread"), tx.rounded(F.count_if(F.col("score") >= 0.2) / F.count("*"), 3).alias("ratio"),
    )


@query("""SELECT CAST(label AS BIGINT) AS label, dim, count(*) AS n, floor(avg(x) * 1e6 + 0.5) / 1e6 AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings) GROUP BY 1, 2""")
def cluster_centroids(read):
    """The mean of every dimension by label."""
    e = read("embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.count("*").alias("n"), tx.rounded(F.avg("x"), 6).alias("mean"))


@query(f"""{MAP_SQL} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, {r('avg(x)', 2)} AS x, {r('avg(y)', 2)} AS y FROM m JOIN embeddings USING (vec_id) GROUP BY 1""")
def cluster_map(read):
    """Where each label's vectors lie on the map of the two widest dimensions, on average."""
    e = read("embeddings")
    at = embedding_map(e).join(e.select("vec_id", "label"), "vec_id")
    return at.groupBy("label").agg(F.count("*").alias("n"), tx.rounded(F.avg("x"), 2).alias("x"), tx.rounded(F.avg("y"), 2).alias("y"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders)
SELECT c_custkey, o_orderkey AS latest FROM customer LEFT JOIN o ON o_custkey = c_custkey AND back = 1""")
def EXT_latest_orders(read):
    o = read("orders").withColumn("back", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where("back = 1")
    return read("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("latest"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def EXT_customers_without_orders(read) -> DataFrame:
    return read("customer").join(read("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


def fixed(x: str) -> str:
    """Two digits of the exact value: the format rounds ties to even, so those, which end in an odd eighth, are rounded apart."""
    return f"CASE WHEN {x} * 8 = floor({x} * 8) AND floor({x} * 8)::BIGINT % 2 = 1 THEN floor({x} * 100 + 0.5) / 100 ELSE CAST(printf('%.2f', {x}) AS DOUBLE) END"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE / 8 AS a, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) * (1 + l_tax::DOUBLE) AS b, (l_partkey % 1000 + 0.005)::DOUBLE AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, {fixed('a')} AS a, {fixed('b')} AS b, {fixed('c')} AS c FROM x""")
def fixed_digits(read):
    """Amounts to two digits by their exact values."""
    price, number = F.col("l_extendedprice").cast("double"), lambda c: F.col(c).cast("double")
    x = read("lineitem").select("l_orderkey", "l_linenumber", (price / 8).alias("a"), (price * (1 - number("l_discount")) * (1 + number("l_tax"))).alias("b"), (F.col("l_partkey") % 1000 + 0.005).alias("c"))
    return x.select("l_orderkey", "l_linenumber", *[tx.to_fixed(F.col(c), 2).alias(c) for c in "abc"])


@query(f"""WITH s AS (SELECT item_id, list_transform(regexp_extract_all(lower(left(text, 12000)), '[\\p{{L}}\\p{{N}}]+'), lambda w: {STEM}) AS s FROM benchmark),
f AS (SELECT item_id, unnest(s) AS f, 1.0::DOUBLE AS w FROM s UNION ALL SELECT item_id, unnest(list_transform(generate_series(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 1])), 0.75 FROM s WHERE len(s) > 1),
g AS (SELECT item_id, {FNV.format('f')} % 256 AS bucket, CASE WHEN {FNV.format("'sign:' || f")} % 2 = 0 THEN w ELSE -w END AS w FROM f), b AS (SELECT item_id, bucket, sum(w) AS x FROM g GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM b GROUP BY 1)
SELECT item_id, bucket, {r('CASE WHEN n > 0 THEN x / n ELSE 0 END', 6)} AS x FROM b JOIN n USING (item_id)""")
def embed_signed_unit(read):
    """Signed counts scaled to length 1."""
    f = read("benchmark").select("item_id", F.explode(signed_hash(F.col("text"))).alias("f"))
    b = f.groupBy("item_id", F.col("f.bucket").alias("bucket")).agg(F.sum("f.weight").alias("x"))
    n = b.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return b.join(n, "item_id").select("item_id", "bucket", tx.rounded(F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(0.0), 6).alias("x"))


@query(f"""WITH {SAMPLES} SELECT CASE WHEN grouping(user_id) = 1 THEN 'all' WHEN grouping(k % 2) = 1 THEN 'index' ELSE 'version' END AS scope, user_id AS index_id, k % 2 AS version, count(*) AS evicted, sum(count(*)) FILTER (WHERE grouping(user_id) = 1) OVER () - count(*) AS kept
FROM s GROUP BY GROUPING SETS ((user_id, k % 2), (user_id), ())""".replace("sum(count(*)) FILTER (WHERE grouping(user_id) = 1) OVER ()", "(SELECT count(*) FROM s)"))
def cache_invalidations(read):
    """What each invalidation would take and leave: of an index's version, of an index, of all."""
    rows = samples(read).select(F.col("user_id").alias("index_id"), (F.col("k") % 2).alias("version"))
    sets = rows.groupingSets([["index_id", "version"], ["index_id"], []], "index_id", "version").agg(F.count("*").alias("evicted"), F.grouping_id("index_id", "version").alias("g"))
    scope = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "index").otherwise("version")
    total = rows.agg(F.count("*").alias("total"))
    return sets.join(F.broadcast(total), F.lit(True)).select(scope.alias("scope"), "index_id", "version", "evicted", (F.col("total") - F.col("evicted")).alias("kept"))
