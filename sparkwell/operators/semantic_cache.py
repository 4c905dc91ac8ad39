"""A semantic cache as a batch: each lookup against what its index held at that moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, let

#: Entries of an index, how long one lives, and the similarity of a hit.
MOST_ENTRIES, TTL_MS, THRESHOLD = 100, 3_600_000, 0.92
#: Requests are numbered within spans of so many milliseconds, then over spans.
SPAN_MS = 3_600_000

#: Why a lookup hits or misses.
NO_ENTRIES, NO_MATCH, BELOW, HIT = "no-cache-entries-for-index", "no-context-match", "below-threshold", "semantic-context-hit"


def context_hash(context: Column) -> Column:
    return F.sha2(F.coalesce(context, F.lit("")), 256)


def cache_key(query: Column, index_id: Column, context: Column, version: Column) -> Column:
    """Twenty-four hex digits of the query's place in the cache; ``context`` is its hash."""
    return F.substring(F.sha2(F.concat_ws("::", query, index_id.cast("string"), context, version), 256), 1, 24)


def numbered(requests: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """Adds ``puts``, ``wipes`` and ``drops``: how many of these came for the index (``drops``: for the index's version) up to this row.

    Counts are made within spans of time, then over the spans' totals, so that no task orders all rows of a frequent index.
    """
    light = requests.select("index_id", "op", "version", "at_ms").withColumns({"span": F.expr(f"at_ms div {span_ms}"), "_v": F.coalesce("version", F.lit(""))})
    counted = {
        "puts": F.col("op") == "put",
        "wipes": (F.col("op") == "invalidate") & F.col("version").isNull(),
        "drops": (F.col("op") == "invalidate") & F.col("version").isNotNull(),
    }

    def before(keys: list[str], names: list[str]) -> DataFrame:
        """What came before each span that occurs."""
        totals = light.groupBy(*keys, "span").agg(*[F.count_if(counted[n]).alias(n) for n in names])
        earlier = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, "span", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in names])

    rows = requests.withColumns({"span": F.expr(f"at_ms div {span_ms}"), "_v": F.coalesce("version", F.lit(""))})
    of_index, of_version = ["index_id"], ["index_id", "_v"]
    for keys, names in ((of_index, ["puts", "wipes"]), (of_version, ["drops"])):
        upto = Window.partitionBy(*keys, "span").orderBy("at_ms", "request_id").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"{n}_in": F.count_if(counted[n]).over(upto) for n in names})
    rows = rows.join(before(of_index, ["puts", "wipes"]), [*of_index, "span"]).join(before(of_version, ["drops"]), [*of_version, "span"])
    rows = rows.withColumns({n: F.col(f"{n}_in") + F.col(f"{n}_before") for n in counted})
    return rows.drop("span", "_v", *[f"{n}_in" for n in counted], *[f"{n}_before" for n in counted])


def lookups(requests: DataFrame, *, most: int = MOST_ENTRIES, ttl_ms: int = TTL_MS, threshold: float = THRESHOLD) -> DataFrame:
    """(request_id, index_id, hit, entry_id, cache_key, similarity, threshold, reason) of every lookup.

    ``requests`` are (request_id, at_ms, index_id, op, version, context, query, embedding, ttl_ms, threshold), the last two of them null where the defaults hold.
    ``op`` is put, lookup or invalidate (of an index, or of one of its versions); requests of an index take effect in the order of
    time, then of number. A lookup sees its index's newest ``most`` puts since the last invalidation of the whole index; of those it skips entries
    that have expired, are of another version or of a version that was invalidated since, or have another context. The most similar one left, the
    newest of equals, is a hit if it reaches the threshold. Entries of an invalidated version keep their place until newer ones
    push them out, and for lookups of other versions the index is not empty while they do.

    Puts are numbered and laid in blocks of ``most``: what a lookup can see lies in two blocks, so it is an equi-join on
    index and block, whatever the index's size, and the best entry is found within the row.
    Null versions and contexts of puts and lookups are those named ''; vectors that are null, of length 0 or of another width are similar to nothing (0).
    """
    plain = requests.select(
        "request_id", "at_ms", "index_id", "op", F.when(F.col("op") == "invalidate", F.col("version")).otherwise(F.coalesce("version", F.lit(""))).alias("version"),
        context_hash(F.col("context")).alias("context"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"),
        F.coalesce("ttl_ms", F.lit(ttl_ms)).alias("ttl_ms"), F.coalesce("threshold", F.lit(threshold)).alias("threshold"),
    )
    rows = numbered(plain)
    entry = F.struct("puts", "request_id", "at_ms", "ttl_ms", "version", "context", "wipes", "drops", "embedding", cache_key(F.col("query"), F.col("index_id"), F.col("context"), F.col("version")).alias("cache_key"))
    puts = rows.where("op = 'put'").withColumn("block", F.floor((F.col("puts") - 1) / most))
    blocks = puts.groupBy("index_id", "block").agg(F.collect_list(entry).alias("held"))  # ``most`` entries at most
    asked = rows.where("op = 'lookup'").withColumn("last", F.floor((F.col("puts") - 1) / most))  # -1 before the first put
    seen = asked.withColumn("block", F.explode(F.array("last", F.col("last") - 1))).join(blocks, ["index_id", "block"], "left")

    def best(held: Column) -> Column:
        """How many entries the index holds at the moment, and the best of those that fit."""
        mine = lambda e: (e["version"] != F.col("version")) | (e["drops"] == F.col("drops"))
        there = F.filter(held, lambda e: (e["puts"] <= F.col("puts")) & (e["puts"] > F.col("puts") - most) & (e["wipes"] == F.col("wipes")) & mine(e))
        fits = lambda e: (F.col("at_ms") - e["at_ms"] <= e["ttl_ms"]) & (e["version"] == F.col("version")) & (e["context"] == F.col("context"))
        scored = lambda e: F.struct(F.coalesce(cosine(e["embedding"], F.col("embedding")), F.lit(0.0)).alias("similarity"), e["puts"].alias("puts"), e["request_id"].alias("entry_id"), e["cache_key"].alias("cache_key"))
        return let(there, lambda t: F.struct(F.size(t).alias("n"), F.array_max(F.transform(F.filter(t, fits), scored)).alias("top")))

    found = seen.withColumn("found", best(F.coalesce("held", F.array().cast(blocks.schema["held"].dataType)))).groupBy("request_id", "index_id", "threshold").agg(
        F.sum("found.n").alias("n"), F.max("found.top").alias("top")
    )
    hit = F.coalesce(F.col("top.similarity") >= F.col("threshold"), F.lit(False))
    reason = F.when(F.col("n") == 0, NO_ENTRIES).when(F.col("top").isNull(), NO_MATCH).when(hit, HIT).otherwise(BELOW)
    return found.select("request_id", "index_id", hit.alias("hit"), F.col("top.entry_id").alias("entry_id"), F.col("top.cache_key").alias("cache_key"), F.col("top.similarity").alias("similarity"), "threshold", reason.alias("reason"))


def metrics(looked: DataFrame, by: list[str]) -> DataFrame:
    """Lookups, hits, misses and the hit rate (four digits) of ``lookups``' rows."""
    out = looked.groupBy(*by).agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return out.withColumn("hit_rate", F.floor(F.col("hits") / F.greatest("lookups", F.lit(1)) * 10_000 + 0.5) / 10_000)
