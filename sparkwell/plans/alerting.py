"""Queries for alerts: quantiles from buckets over sliding ranges, and states that hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import alerts
from .operations import SAMPLES, r, samples
from .registry import query

#: Bounds of the latency buckets; evaluations each hour over the six hours before.
BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
STEP_S, RANGE_S = 3600, 6 * 3600
#: Name, limit, whether a value above it (or below) is over, and how long that must hold.
RULES = (("HighErrorRate", 0.2, True, 3 * STEP_S), ("HighLatency", 230.0, True, 3 * STEP_S), ("LowSuccessRate", 0.75, False, 6 * STEP_S), ("HighRetryRate", 0.5, True, 2 * STEP_S))

_ENDS = ", ".join(str(b) for b in BOUNDS)
_COUNTS = ", ".join(f"count(*) FILTER (WHERE value <= {b})" for b in BOUNDS)
#: As ``histogram_quantile`` has it, from counts ``c`` and bounds ``ends``.
QUANTILE_SQL = """CASE WHEN c[-1] > 0 THEN CASE WHEN i >= {n} THEN ends[{n}] ELSE coalesce(ends[nullif(i, 0)], 0) + (ends[i + 1] - coalesce(ends[nullif(i, 0)], 0)) * (0.99::DOUBLE * c[-1] - coalesce(c[nullif(i, 0)], 0)) / (c[i + 1] - coalesce(c[nullif(i, 0)], 0)) END END""".format(n=len(BOUNDS))
RANGES_SQL = f"""{SAMPLES}, grid AS (SELECT *, unnest(range(1, {RANGE_S // STEP_S + 1})) AS j FROM s),
w AS (SELECT event_type, (epoch_us(ts) // {STEP_S * 1_000_000} + j) * {STEP_S} AS moment, value, failed, k FROM grid)"""


@query(f"""WITH {RANGES_SQL}, h AS (SELECT event_type, moment, count(*) AS n, [{_COUNTS}, count(value)] AS c, [{_ENDS}]::DOUBLE[] AS ends FROM w GROUP BY 1, 2),
p AS (SELECT *, len(list_filter(c, lambda x: x < 0.99::DOUBLE * c[-1])) AS i FROM h)
SELECT event_type, moment, n, n / {float(RANGE_S)} AS rate, {r(QUANTILE_SQL, 6)} AS p99 FROM p""")
def latency_quantiles(read):
    """Rate and 99th percentile of each kind's last six hours, hour by hour, from bucket counts alone."""
    found = alerts.ranges(samples(read), "ts", ["event_type"], "6 hours", "1 hour", n=F.count("*"), counts=alerts.bucket_counts(F.col("value"), BOUNDS))
    p99 = alerts.histogram_quantile(0.99, BOUNDS, F.col("counts"))
    return found.select("event_type", F.col("at").alias("moment"), "n", (F.col("n") / float(RANGE_S)).alias("rate"), tx.rounded(p99, 6).alias("p99"))


def evaluations(read) -> DataFrame:
    """(alert, at, value, over, hold_s) of every rule at every hour."""
    k, n = F.col("k"), F.count("*")
    found = alerts.ranges(
        samples(read), "ts", [], "6 hours", "1 hour", HighErrorRate=F.count_if("failed") / n, HighLatency=alerts.bucket_counts(F.col("value"), BOUNDS),
        LowSuccessRate=F.count_if(~F.col("failed")) / n, HighRetryRate=F.count_if(k >= 50) / F.greatest(F.count_if(k >= 1), F.lit(1)),
    )
    found = found.withColumn("HighLatency", alerts.histogram_quantile(0.99, BOUNDS, F.col("HighLatency")))
    rows = found.unpivot(["at"], [rule[0] for rule in RULES], "alert", "value")
    over, hold = F.lit(None).cast("boolean"), F.lit(None).cast("bigint")
    for name, limit, above, hold_s in RULES:
        mine = F.col("alert") == name
        over = F.when(mine, F.col("value") > limit if above else F.col("value") < limit).otherwise(over)
        hold = F.when(mine, F.lit(hold_s).cast("bigint")).otherwise(hold)
    return rows.select("alert", "at", "value", over.alias("over"), hold.alias("hold_s"))


STATES_SQL = f"""WITH {RANGES_SQL}, h AS (SELECT moment, count(*) FILTER (WHERE failed) / count(*)::DOUBLE AS "HighErrorRate", [{_COUNTS}, count(value)] AS c, [{_ENDS}]::DOUBLE[] AS ends,
  count(*) FILTER (WHERE NOT failed) / count(*)::DOUBLE AS "LowSuccessRate", count(*) FILTER (WHERE k >= 50) / greatest(count(*) FILTER (WHERE k >= 1), 1)::DOUBLE AS "HighRetryRate" FROM w GROUP BY 1),
i AS (SELECT *, len(list_filter(c, lambda x: x < 0.99::DOUBLE * c[-1])) AS i FROM h), q AS (SELECT *, {QUANTILE_SQL} AS "HighLatency" FROM i),
u AS (SELECT alert, moment, value FROM q UNPIVOT (value FOR alert IN ("HighErrorRate", "HighLatency", "LowSuccessRate", "HighRetryRate"))),
rules(alert, lim, above, hold_s) AS (VALUES {", ".join(f"('{a}', {b}::DOUBLE, {c}, {d})" for a, b, c, d in RULES)}),
o AS (SELECT alert, moment, value, hold_s, CASE WHEN above THEN value > lim ELSE value < lim END AS over FROM u JOIN rules USING (alert)),
g AS (SELECT *, moment - {STEP_S} * row_number() OVER (PARTITION BY alert, over ORDER BY moment) AS run FROM o),
z AS (SELECT *, CASE WHEN over THEN min(moment) OVER (PARTITION BY alert, over, run) END AS since FROM g),
st AS (SELECT alert, moment, value, since, CASE WHEN NOT over THEN 'inactive' WHEN moment - since >= hold_s THEN 'firing' ELSE 'pending' END AS state FROM z)"""


@query(f"{STATES_SQL} SELECT alert, moment, {r('value', 6)} AS value, since, state FROM st")
def alert_states(read):
    """Whether each alert is inactive, pending or firing at each hour, and since when."""
    found = alerts.states(evaluations(read), ["alert"], F.col("over"), F.col("hold_s"), STEP_S)
    return found.select("alert", F.col("at").alias("moment"), tx.rounded(F.col("value"), 6).alias("value"), "since", "state")


@query(f"{STATES_SQL} SELECT alert, since, max(moment) AS until, count(*) AS evaluations, max({r('value', 6)}) AS highest FROM st WHERE state = 'firing' GROUP BY 1, 2")
def alert_incidents(read):
    """Each time that an alert fired: since when it was over its limit, until when, and how high."""
    found = alerts.states(evaluations(read), ["alert"], F.col("over"), F.col("hold_s"), STEP_S).where(F.col("state") == alerts.FIRING)
    return found.groupBy("alert", "since").agg(F.max("at").alias("until"), F.count("*").alias("evaluations"), F.max(tx.rounded(F.col("value"), 6)).alias("highest"))
