"""Queries over event samples: latency and cost reports, queues, budgets, trends, alerts, caches, memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.search import topk
from .registry import query


def r(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def samples(read):
    """Events as request samples: errors are failures, the value is a latency, the user a session."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return read("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"), (F.col("event_type") == "error").alias("failed"))


SAMPLES = "s AS (SELECT *, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, event_type = 'error' AS failed FROM events)"


@query(f"""WITH {SAMPLES} SELECT coalesce(event_type, 'all') AS provider, count(*) AS requests, {r('avg(value)', 2)} AS avg_latency, {r('quantile_disc(value, 0.95)', 2)} AS p95_latency,
  {r('avg(value * 0.001)', 6)} AS avg_cost, {r('avg(CASE WHEN k >= 5 THEN 1.0 ELSE 0.0 END)', 4)} AS grounded_rate, {r('avg(k)', 2)} AS avg_results
FROM s GROUP BY GROUPING SETS ((event_type), ())""")
def tradeoff_metrics(read):
    s = samples(read)
    out = s.groupingSets([["event_type"], []], "event_type").agg(
        F.count("*").alias("requests"), tx.rounded(F.avg("value"), 2).alias("avg_latency"), tx.rounded(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 2).alias("p95_latency"),
        tx.rounded(F.avg(F.col("value") * 0.001), 6).alias("avg_cost"), tx.rounded(F.avg(F.when(F.col("k") >= 5, 1.0).otherwise(0.0)), 4).alias("grounded_rate"), tx.rounded(F.avg("k"), 2).alias("avg_results"),
    )
    return out.withColumn("provider", F.coalesce("event_type", F.lit("all"))).drop("event_type")


@query(f"""WITH {SAMPLES}, recent AS (SELECT * FROM s ORDER BY ts DESC, event_id DESC LIMIT 500)
SELECT event_type AS component, count(*) AS n, count(*) FILTER (WHERE failed) AS failures, CAST(sum(k) AS BIGINT) AS retries, {r('avg(value)', 3)} AS avg_duration FROM recent GROUP BY 1""")
def observability_summary(read):
    recent = samples(read).orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return recent.groupBy(F.col("event_type").alias("component")).agg(
        F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.sum("k").alias("retries"), tx.rounded(F.avg("value"), 3).alias("avg_duration")
    )


def _last(read, n):
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return samples(read).withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


LAST = f"WITH {SAMPLES}, l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM s QUALIFY back <= 512)"


@query(f"{LAST} SELECT event_type AS queue, count(*) AS n, {r('avg(value)', 2)} AS mean, {r('quantile_cont(value, 0.95)', 2)} AS p95 FROM l GROUP BY 1")
def queue_p95_interpolated(read):
    return _last(read, 512).groupBy(F.col("event_type").alias("queue")).agg(
        F.count("*").alias("n"), tx.rounded(F.avg("value"), 2).alias("mean"), tx.rounded(F.expr("percentile(value, 0.95)"), 2).alias("p95")
    )


@query(f"{LAST} SELECT event_type AS queue, {r('quantile_disc(value, 0.95)', 2)} AS p95 FROM l GROUP BY 1")
def queue_p95_nearest(read):
    return _last(read, 512).groupBy(F.col("event_type").alias("queue")).agg(tx.rounded(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 2).alias("p95"))


@query(f"""{LAST}, a AS (SELECT event_type, list_sort(list(value)) AS v FROM l GROUP BY 1), p AS (SELECT *, 0.95 * (len(v) + 1) AS at FROM a)
SELECT event_type AS queue, {r('v[CAST(floor(at) AS BIGINT)] + (at - floor(at)) * (v[CAST(floor(at) AS BIGINT) + 1] - v[CAST(floor(at) AS BIGINT)])', 4)} AS exclusive, {r('v[CAST(floor(0.95 * len(v)) AS BIGINT)]', 4)} AS floored FROM p""".replace(" AS at ", " AS place ").replace("(at)", "(place)").replace("(at -", "(place -"))
def queue_p95_variants(read):
    """The exclusive method and the floored index; each queue's window has 512 values at most."""
    v = _last(read, 512).groupBy("event_type").agg(F.sort_array(F.collect_list("value")).alias("v"))
    at = 0.95 * (F.size("v") + 1)
    low = F.floor(at).cast("int")
    inside = F.get("v", low - 1) + (at - F.floor(at)) * (F.get("v", low) - F.get("v", low - 1))
    return v.select(F.col("event_type").alias("queue"), tx.rounded(inside, 4).alias("exclusive"), tx.rounded(F.get("v", F.floor(0.95 * F.size("v")).cast("int") - 1), 4).alias("floored"))


@query(f"""WITH {SAMPLES} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {r("sum(CASE WHEN event_type = 'view' THEN value * 0.001 ELSE 0 END)", 6)} AS embeddings, {r("sum(CASE WHEN event_type IN ('click', 'signup') THEN value * 0.001 ELSE 0 END)", 6)} AS retrieval,
  {r("greatest(0, sum(value * 0.001) - sum(CASE WHEN event_type IN ('view', 'click', 'signup') THEN value * 0.001 ELSE 0 END))", 6)} AS generation, {r('sum(value * 0.001)', 6)} AS total FROM s GROUP BY 1""")
def cost_daily(read):
    cost = F.col("value") * 0.001
    part = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), cost).otherwise(0.0))
    return samples(read).groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        tx.rounded(part("view"), 6).alias("embeddings"), tx.rounded(part("click", "signup"), 6).alias("retrieval"),
        tx.rounded(F.greatest(F.lit(0.0), F.sum(cost) - part("view", "click", "signup")), 6).alias("generation"), tx.rounded(F.sum(cost), 6).alias("total"),
    )


@query(f"""WITH {SAMPLES}, c AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS units FROM s),
t AS (SELECT *, CAST(sum(units) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS BIGINT) AS spent FROM c)
SELECT event_id, spent, spent <= 100000 AS within, greatest(0, 100000 - spent) AS remaining FROM t""")
def budget_running(read):
    """Each user's spending of the day so far, in thousandths, against a limit."""
    s = samples(read).withColumn("units", F.bround(F.col("value") * 1000).cast("bigint")).withColumn("day", F.to_date("ts"))
    spent = F.sum("units").over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("spent", spent).select("event_id", "spent", (F.col("spent") <= 100000).alias("within"), F.greatest(F.lit(0), 100000 - F.col("spent")).alias("remaining"))


@query(f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM s QUALIFY back <= 20),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM n),
h AS (SELECT user_id, max(n) AS n, avg(value) FILTER (WHERE back > n - n // 2) AS early, avg(value) FILTER (WHERE back <= n - n // 2) AS late FROM c GROUP BY 1)
SELECT user_id, n, CASE WHEN n < 4 THEN 'stable' WHEN late - early > 0.05 THEN 'improving' WHEN late - early < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM h""")
def eval_trend(read):
    """Direction of each session's last twenty values: the mean of the later half against the earlier."""
    w = Window.partitionBy("user_id")
    n = samples(read).withColumn("back", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).where("back <= 20").withColumn("n", F.count("*").over(w))
    early = F.col("back") > F.col("n") - F.floor(F.col("n") / 2)
    h = n.groupBy("user_id").agg(F.max("n").alias("n"), F.avg(F.when(early, F.col("value"))).alias("early"), F.avg(F.when(~early, F.col("value"))).alias("late"))
    change = F.col("late") - F.col("early")
    return h.select("user_id", "n", F.when(F.col("n") < 4, "stable").when(change > 0.05, "improving").when(change < -0.05, "declining").otherwise("stable").alias("trend"))


@query(f"WITH {SAMPLES} SELECT event_id, {r('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 4)} AS mean_of_5, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS max_of_5 FROM s")
def last_n_frame(read):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return samples(read).select("event_id", tx.rounded(F.avg("value").over(w), 4).alias("mean_of_5"), F.max("value").over(w).alias("max_of_5"))


@query("""WITH j AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 5 WHEN event_type = 'purchase' THEN 4 ELSE 3 END AS most FROM events)
SELECT event_id, a AS attempt, CASE WHEN event_type = 'purchase' THEN 3000 WHEN event_type = 'error' THEN 2000 * CAST(pow(2, a - 1) AS BIGINT) ELSE 1000 * CAST(pow(2, a - 1) AS BIGINT) END AS delay_ms FROM (SELECT *, unnest(generate_series(1, most)) AS a FROM j)""")
def backoff_schedule(read):
    """Delays of each job's attempts: fixed for one kind of job, doubling for the others."""
    kind = F.col("event_type")
    most = F.when(kind == "error", 5).when(kind == "purchase", 4).otherwise(3)
    jobs = read("events").select("event_id", "event_type", F.explode(F.sequence(F.lit(1), most)).alias("attempt"))
    double = F.pow(F.lit(2.0), F.col("attempt") - 1).cast("bigint")
    return jobs.select("event_id", "attempt", F.when(kind == "purchase", F.lit(3000).cast("bigint")).when(kind == "error", 2000 * double).otherwise(1000 * double).alias("delay_ms"))


@query(f"""WITH {SAMPLES} SELECT event_type AS job_type, count(*) AS jobs, count(*) FILTER (WHERE k >= 5) AS dead, count(*) FILTER (WHERE k < 5) AS retried FROM s GROUP BY 1""")
def dlq_split(read):
    """Jobs whose attempts are used up go to the dead letters, the others are tried again."""
    return samples(read).groupBy(F.col("event_type").alias("job_type")).agg(F.count("*").alias("jobs"), F.count_if(F.col("k") >= 5).alias("dead"), F.count_if(F.col("k") < 5).alias("retried"))


@query(f"""WITH {SAMPLES}, w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS n, count(*) FILTER (WHERE failed) AS failures FROM s GROUP BY 1)
SELECT epoch_us(start) // 1000000 AS start, n, failures, {r('n / 300.0', 6)} AS rate, failures > 0.05 * n AS alert FROM w""")
def rate_5m(read):
    w = samples(read).groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))
    return w.select(F.unix_timestamp("w.start").alias("start"), "n", "failures", tx.rounded(F.col("n") / 300.0, 6).alias("rate"), (F.col("failures") > 0.05 * F.col("n")).alias("alert"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_ms(ts) AS ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, ms, event_id, ms AS anchor, CAST(1 AS BIGINT) AS n FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.ms, e.event_id, CASE WHEN e.ms - w.anchor >= 86400000 THEN e.ms ELSE w.anchor END, CASE WHEN e.ms - w.anchor >= 86400000 THEN CAST(1 AS BIGINT) ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, n AS in_window, n <= 3 AS allowed FROM w""")
def rate_limiter(read):
    """A window opens with a user's first event and lasts a day; three events pass in each.

    The window an event falls in depends on all before it, which expressions cannot say; a running state per user can,
    and one user's events are streamed through it in order, batch by batch.
    """
    import pandas as pd

    def run(batches):
        state: dict[int, tuple[int, int]] = {}
        user = None
        for pdf in batches:
            counts = []
            for u, ms in zip(pdf["user_id"], pdf["ms"], strict=True):
                if u != user:  # sorted by user: the state of one is enough
                    state.clear()
                    user = u
                anchor, n = state.get(u, (ms, 0))
                anchor, n = (ms, 1) if ms - anchor >= 86_400_000 else (anchor, n + 1)
                state[u] = anchor, n
                counts.append(n)
            yield pd.DataFrame({"event_id": pdf["event_id"], "in_window": counts, "allowed": [n <= 3 for n in counts]})

    events = samples(read).select("event_id", "user_id", F.unix_millis("ts").alias("ms"))
    return events.repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id").mapInPandas(run, "event_id bigint, in_window bigint, allowed boolean")


TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query(f"""WITH m AS (SELECT conv_id, turn, {TOK.format('text')} AS w FROM conversations WHERE role = 'assistant'),
q AS (SELECT conv_id, turn, {TOK.format('text')} AS w FROM conversations WHERE role = 'user'),
x AS (SELECT q.conv_id, q.turn, m.turn AS found, {r('len(list_intersect(q.w, m.w)) / len(q.w)', 4)} AS score FROM q JOIN m ON q.conv_id = m.conv_id AND m.turn < q.turn WHERE len(list_intersect(q.w, m.w)) > 0)
SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, found DESC) AS rank FROM x QUALIFY rank <= 3""")
def session_memory_search(read):
    """For each user turn, the earlier answers of the session that share most of its words."""
    c = read("conversations").withColumn("w", F.array_distinct(tx.words("text")))
    q, m = c.where("role = 'user'").select("conv_id", "turn", "w"), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("found"), F.col("w").alias("v"))
    both = F.size(F.array_intersect("w", "v"))
    x = q.join(m, "conv_id").where((F.col("found") < F.col("turn")) & (both > 0)).select("conv_id", "turn", "found", tx.rounded(both / F.size("w"), 4).alias("score"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), F.desc("found")))).where("rank <= 3")


@query("""WITH c AS (SELECT user_id AS index_id, event_id, epoch_ms(ts) AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS version FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY ms DESC, event_id DESC) AS back, max(ms) OVER () AS now FROM c)
SELECT event_id, back > 5 AS evicted, now - ms > 3600000 AS expired FROM n""")
def cache_evict(read):
    """Entries beyond the newest five of their index go, and those older than an hour have expired."""
    c = samples(read).select(F.col("user_id").alias("index_id"), "event_id", F.unix_millis("ts").alias("ms"))
    now = c.agg(F.max("ms").alias("now"))
    n = c.withColumn("back", F.row_number().over(Window.partitionBy("index_id").orderBy(F.desc("ms"), F.desc("event_id"))))
    return n.join(F.broadcast(now), F.lit(True)).select("event_id", (F.col("back") > 5).alias("evicted"), (F.col("now") - F.col("ms") > 3_600_000).alias("expired"))


@query(f"""WITH s AS (SELECT q.vec_id, e.vec_id AS hit, floor(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS score
  FROM embeddings q JOIN embeddings e ON q.label = e.label AND e.vec_id % 50 <> 0 WHERE q.vec_id % 50 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, hit) AS n FROM s QUALIFY n = 1)
SELECT q.vec_id, CASE WHEN b.score >= 0.92 THEN b.hit END AS hit, b.score, CASE WHEN b.hit IS NULL THEN 'no entries' WHEN b.score >= 0.92 THEN 'hit' ELSE 'below threshold' END AS reason
FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN b USING (vec_id)""")
def cache_lookup(read):
    """The most similar entry of the query's own index, if it is similar enough."""
    e = read("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id % 50 = 0")
    best = topk(q.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), "label"), e.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("id"), "v", "label"), 1, digits=6, within="label")
    out = q.select("vec_id").join(best.select(F.col("query_id").alias("vec_id"), "score", F.col("id").alias("found")), "vec_id", "left")
    good = F.col("score") >= 0.92
    reason = F.when(F.col("found").isNull(), "no entries").when(good, "hit").otherwise("below threshold")
    return out.select("vec_id", F.when(good, F.col("found")).alias("hit"), "score", reason.alias("reason"))


SERIES = {
    "queue_jobs_succeeded_total": "counter", "queue_jobs_failed_total": "counter", "queue_jobs_retrying_total": "counter", "queue_jobs_dlq_total": "counter",
    "queue_attempts_total": "counter", "queue_duration_ms_average": "gauge", "queue_duration_ms_p95": "gauge",
}


@query(f"""WITH {SAMPLES}, g AS (SELECT event_type AS queue, count(*) FILTER (WHERE NOT failed)::DOUBLE AS queue_jobs_succeeded_total, count(*) FILTER (WHERE failed)::DOUBLE AS queue_jobs_failed_total, count(*) FILTER (WHERE k BETWEEN 3 AND 4)::DOUBLE AS queue_jobs_retrying_total,
  count(*) FILTER (WHERE k >= 5)::DOUBLE AS queue_jobs_dlq_total, sum(k)::DOUBLE AS queue_attempts_total, {r('avg(value)', 2)} AS queue_duration_ms_average, {r('quantile_cont(value, 0.95)', 2)} AS queue_duration_ms_p95 FROM s GROUP BY 1),
u AS (UNPIVOT g ON {', '.join(SERIES)} INTO NAME name VALUE value)
SELECT name, CASE WHEN name LIKE '%_total' THEN 'counter' ELSE 'gauge' END AS type, '{{queue="' || replace(queue, '"', '\\"') || '",job_type="' || replace(queue, '"', '\\"') || '"}}' AS labels, value FROM u""")
def metric_exposition(read):
    """One row for each series, as a scraper wants them."""
    k = F.col("k")
    g = samples(read).groupBy(F.col("event_type").alias("queue")).agg(
        F.count_if(~F.col("failed")).cast("double").alias("queue_jobs_succeeded_total"), F.count_if("failed").cast("double").alias("queue_jobs_failed_total"),
        F.count_if(k.between(3, 4)).cast("double").alias("queue_jobs_retrying_total"), F.count_if(k >= 5).cast("double").alias("queue_jobs_dlq_total"), F.sum("k").cast("double").alias("queue_attempts_total"),
        tx.rounded(F.avg("value"), 2).alias("queue_duration_ms_average"), tx.rounded(F.expr("percentile(value, 0.95)"), 2).alias("queue_duration_ms_p95"),
    )
    kind = F.when(F.col("name").endswith("_total"), "counter").otherwise("gauge")
    return g.unpivot(["queue"], list(SERIES), "name", "value").select("name", kind.alias("type"), tx.label_set(queue=F.col("queue"), job_type=F.col("queue")).alias("labels"), "value")


def exposition_text(series) -> list[str]:
    """The lines of a text exposition of ``metric_exposition``'s rows: a few for each queue."""
    lines = [f"# TYPE {name} {kind}" for name, kind in SERIES.items()]
    return [*lines, *(f"{s.name}{s.labels} {s.value:g}" for s in sorted(series.collect(), key=lambda s: (s.labels, list(SERIES).index(s.name)))), "# EOF"]


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_latest(read):
    return samples(read).where("failed").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "value")


@query("SELECT event_type, user_id % 10 AS shard, count(*) AS n, grouping_id(event_type, user_id % 10) AS level FROM events GROUP BY CUBE (event_type, user_id % 10)")
def EXT_event_cube(read):
    e = read("events").withColumn("shard", F.col("user_id") % 10)
    return e.cube("event_type", "shard").agg(F.count("*").alias("n"), F.grouping_id("event_type", "shard").alias("level"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, epoch_us(min(ts)) AS began, count(*) AS n FROM s GROUP BY user_id, session""")
def EXT_sessions(read):
    s = samples(read).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("began"), "n")


@query("""SELECT c_mktsegment AS segment, n_name AS nation, count(DISTINCT o_orderkey) AS orders, CAST(sum(l_quantity) AS BIGINT) AS quantity, floor(sum(l_extendedprice * (1 - l_discount)) / 1000 + 0.5) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def EXT_segment_revenue(read):
    joined = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")).agg(
        F.countDistinct("o_orderkey").alias("orders"), F.sum("l_quantity").cast("bigint").alias("quantity"),
        F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000 + 0.5).cast("double").alias("revenue"),
    )
