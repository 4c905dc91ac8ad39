"""Snapshots of answered questions compared part by part, and variants of a pipeline decided by paired questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: One answered question: what was retrieved, how it was reranked, and what was said at what cost.
SNAPSHOT = (
    "id bigint, chunks array<struct<chunk_id:string,rank:int,score:double>>, reranking array<struct<chunk_id:string,before:int,after:int,score:double>>, answer string, grounded boolean,"
    " model string, provider string, embedding string, cost_usd double, latency_ms double"
)


def compare_snapshots(original: DataFrame, replay: DataFrame, id: str = "id") -> DataFrame:
    """Part by part, what a replay changed, for each id that both have; one that a side lacks is ``missing_in`` it.

    (id, added, removed, reordered: arrays of chunk ids; score_deltas: structs (chunk_id, original, replay, delta), three digits, those that are not 0 or unknown;
    reranking_changed and a flag for each part; cost_delta, latency_delta; status: matched or diverged; missing_in.) Rerankings are equal if they are
    structure for structure, order included. Chunks that come twice are taken by their first place. Null lists are empty, null answers are empty ones.
    All of it is array work within the joined row.
    """
    o, r = original.alias("o"), replay.alias("r")
    joined = o.join(r, F.col(f"o.{id}") == F.col(f"r.{id}"), "full")
    chunks = lambda side: F.coalesce(F.col(f"{side}.chunks"), F.array().cast("array<struct<chunk_id:string,rank:int,score:double>>"))
    mine, theirs = chunks("o"), chunks("r")
    ids = lambda c: F.array_distinct(F.transform(c, lambda x: x["chunk_id"]))
    in_replay = lambda x: F.get(F.filter(theirs, lambda y: y["chunk_id"] == x["chunk_id"]), F.lit(0))
    first = F.filter(mine, lambda x, i: ~F.exists(F.slice(mine, F.lit(1), i), lambda y: y["chunk_id"] == x["chunk_id"]))
    pairs = F.transform(first, lambda x: F.struct(x.alias("x"), in_replay(x).alias("y")))
    both = F.filter(pairs, lambda p: p["y"].isNotNull())
    moved = F.transform(F.filter(both, lambda p: ~p["x"]["rank"].eqNullSafe(p["y"]["rank"])), lambda p: p["x"]["chunk_id"])
    deltas = F.transform(both, lambda p: F.struct(
        p["x"]["chunk_id"].alias("chunk_id"), p["x"]["score"].alias("original"), p["y"]["score"].alias("replay"), tx.rounded(p["y"]["score"] - p["x"]["score"], 3).alias("delta")))
    deltas = F.filter(deltas, lambda d: d["delta"].isNull() | (d["delta"] != 0))
    differs = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}"))
    said = lambda side: tx.collapsed(F.coalesce(F.col(f"{side}.answer"), F.lit("")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    empty = F.array().cast("array<struct<chunk_id:string,before:int,after:int,score:double>>")
    reranked = F.coalesce(F.col("o.reranking"), empty) != F.coalesce(F.col("r.reranking"), empty)
    out = joined.select(
        F.coalesce(f"o.{id}", f"r.{id}").alias(id), F.when(F.col(f"o.{id}").isNull(), "original").when(F.col(f"r.{id}").isNull(), "replay").alias("missing_in"),
        F.array_except(ids(theirs), ids(mine)).alias("added"), F.array_except(ids(mine), ids(theirs)).alias("removed"), moved.alias("reordered"), deltas.alias("score_deltas"),
        reranked.alias("reranking_changed"), (said("o") != said("r")).alias("response_changed"), differs("grounded").alias("groundedness_changed"), differs("model").alias("model_changed"),
        differs("provider").alias("provider_changed"), differs("embedding").alias("embedding_changed"),
        tx.rounded(zero("r.cost_usd") - zero("o.cost_usd"), 6).alias("cost_delta"), tx.rounded(zero("r.latency_ms") - zero("o.latency_ms"), 3).alias("latency_delta"),
    )
    some = lambda c: F.size(c) > 0
    out = out.withColumns({"order_changed": some("reordered"), "scores_changed": some("score_deltas")})
    out = out.withColumn("retrieval_changed", some("added") | some("removed") | F.col("order_changed") | F.col("scores_changed") | F.col("reranking_changed"))
    changed = F.col("missing_in").isNotNull()
    for flag in ("response", "retrieval", "groundedness", "model", "provider", "embedding"):
        changed = changed | F.col(f"{flag}_changed")
    return out.withColumn("status", F.when(changed, "diverged").otherwise("matched"))


def summary() -> Column:
    """Sentences on what stayed and what changed, for rows of ``compare_snapshots``."""
    either = lambda flag, yes, no: F.when(F.col(flag), yes).otherwise(no)
    return F.array_compact(F.array(
        either("response_changed", "The answer changed.", "The answer stayed the same."), either("retrieval_changed", "The evidence changed.", "The evidence stayed the same."),
        either("groundedness_changed", "Groundedness changed.", "Groundedness stayed the same."), either("order_changed", "The chunks' order changed.", "The chunks' order stayed the same."),
        either("scores_changed", "The chunks' scores changed.", "The chunks' scores stayed the same."), F.when(F.col("model_changed"), "Another model answered."),
        F.when(F.col("provider_changed") | F.col("embedding_changed"), "Another provider was used.")))


#: One question answered by one variant.
RUN = (
    "variant string, query_id bigint, answer string, faithfulness double, relevance double, recall double, groundedness double, quality double, latency_ms double, cost_usd double,"
    " refused boolean"
)
#: Least differences that count: groundedness, recall, refusals, quality; latency and cost absolutely and as a part of the baseline's. Changed answers beyond that share need a gain.
GROUNDED, RECALL, REFUSED, BETTER, LATENCY, COST, CHANGED = 0.02, 0.01, 0.01, 0.02, (1.0, 0.05), (1e-6, 0.1), 0.4


def variant_metrics(runs: DataFrame) -> DataFrame:
    """(variant, n, avg_<score> ..., avg_latency_ms, avg_cost_usd, refusal_rate) of RUN rows; null scores count 0.

    Six digits of each number are summed as integers, so that means are the same in whatever order rows come.
    """
    mean = lambda c: tx.exact_mean(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 1_000_000)
    names = ("faithfulness", "relevance", "recall", "groundedness", "quality", "latency_ms", "cost_usd")
    return runs.groupBy("variant").agg(F.count("*").alias("n"), *[mean(c).alias(f"avg_{c}") for c in names], F.avg(F.coalesce("refused", F.lit(False)).cast("double")).alias("refusal_rate"))


def affected(runs: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(query_id, response_changed, reasons) of the candidate's questions whose answer changed or got worse, paired with the baseline's by question.

    A question that the baseline lacks is compared with an empty answer and scores of 0.
    """
    n, b = runs.where(F.col("variant") == candidate).alias("n"), runs.where(F.col("variant") == baseline).alias("b")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    said = lambda side: tx.collapsed(F.coalesce(F.col(f"{side}.answer"), F.lit("")))
    refused = lambda side: F.coalesce(F.col(f"{side}.refused"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(zero("n.groundedness") < zero("b.groundedness") - GROUNDED, "groundedness_drop"), F.when(zero("n.recall") < zero("b.recall") - RECALL, "recall_drop"),
        F.when(zero("n.cost_usd") > zero("b.cost_usd"), "cost_increase"), F.when(zero("n.latency_ms") > zero("b.latency_ms") + 1, "latency_increase"),
        F.when(refused("n") & ~refused("b"), "new_refusal")))
    pairs = n.join(b, F.col("n.query_id") == F.col("b.query_id"), "left")
    rows = pairs.select(F.col("n.query_id").alias("query_id"), (said("n") != said("b")).alias("response_changed"), reasons.alias("reasons"))
    return rows.where(F.col("response_changed") | (F.size("reasons") > 0))


def decision(runs: DataFrame, baseline: str) -> DataFrame:
    """One row: (baseline, candidate, winner, response_change_rate, regressions, improvements, recommendation).

    The candidate is the other variant of the best mean quality (equal ones: the first by name). A regression blocks it; it is promoted if it wins by something
    and nothing regressed; else somebody has to look. No runs of the baseline or of others give no row.
    """
    metrics = variant_metrics(runs)
    place = F.row_number().over(Window.orderBy(F.desc("avg_quality"), F.col("variant") != baseline, "variant"))  # a row for each variant
    ranked = metrics.withColumn("place", place)
    winner = ranked.where("place = 1").select(F.col("variant").alias("winner"))
    best = ranked.where(F.col("variant") != baseline).orderBy("place").limit(1)
    c, b = best.alias("c"), ranked.where(F.col("variant") == baseline).alias("b")
    both = c.join(b, F.lit(True)).join(winner, F.lit(True))
    # Questions paired by id; which variant is the candidate comes with the row, not through the driver.
    n = runs.join(best.select(F.col("variant").alias("is")), F.col("variant") == F.col("is"), "left_semi").select("query_id", tx.collapsed(F.coalesce("answer", F.lit(""))).alias("said"))
    old = runs.where(F.col("variant") == baseline).select(F.col("query_id").alias("q"), tx.collapsed(F.coalesce("answer", F.lit(""))).alias("was"))
    changed = n.join(old, F.col("query_id") == F.col("q"), "left").agg(tx.rounded(F.count_if(F.col("said") != F.coalesce("was", F.lit(""))) / F.greatest(F.count("*"), F.lit(1)), 4).alias("rate"))
    delta = lambda m: F.col(f"c.{m}") - F.col(f"b.{m}")
    room = lambda limits, m: F.greatest(F.lit(limits[0]), F.col(f"b.{m}") * limits[1])
    up, down = [], []
    for name, d, least, more_is_better in (
        ("groundedness", delta("avg_groundedness"), F.lit(GROUNDED), True), ("recall", delta("avg_recall"), F.lit(RECALL), True), ("latency", delta("avg_latency_ms"), room(LATENCY, "avg_latency_ms"), False),
        ("cost", delta("avg_cost_usd"), room(COST, "avg_cost_usd"), False), ("refusals", delta("refusal_rate"), F.lit(REFUSED), False),
    ):
        up.append(F.when(d > least if more_is_better else d < -least, name))
        down.append(F.when(d < -least if more_is_better else d > least, name))
    up.append(F.when(delta("avg_quality") > BETTER, "quality"))
    gain = (delta("avg_quality") > BETTER) | (delta("avg_groundedness") > GROUNDED) | (delta("avg_recall") > GROUNDED)
    down.append(F.when((F.col("rate") > CHANGED) & ~gain, "answers"))
    out = both.join(changed, F.lit(True)).select(
        F.col("b.variant").alias("baseline"), F.col("c.variant").alias("candidate"), "winner", F.col("rate").alias("response_change_rate"), F.array_compact(F.array(*down)).alias("regressions"),
        F.array_compact(F.array(*up)).alias("improvements"),
    )
    verdict = F.when(F.size("regressions") > 0, "block").when((F.col("winner") == F.col("candidate")) & (F.size("improvements") > 0), "promote").otherwise("manual_review")
    return out.withColumn("recommendation", verdict)
