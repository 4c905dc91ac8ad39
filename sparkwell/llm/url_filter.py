"""Url verdicts: the longest rule that fits, else trust and distrust that links carry from host to host."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (rule, verdict); a rule is a host and a path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Rules are part of the plan, so that pages need no join for them; longer lists are refused.
MOST_RULES = 1000
#: Damping; steps between checkpoints, and the difference to LINK_MARGIN below which a host is decided by what has been reached.
DAMPING, STEPS, TOLERANCE = 0.85, 4, 1e-6
#: Links block a host if the distrust of those it links to exceeds the trust of those that link to it, both from 0 to 1, by more than this.
LINK_MARGIN = 0.25
#: Rules alone block a host if the share of its pages that they block exceeds the share that they allow by more than this.
MARGIN = 0.5

LINK = r"""(?i)(?<![\w-])href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest rule for this host or a domain above it whose path begins the url's; else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): pages' links between different hosts, counted. ``pages`` has the columns host and html."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("link"))
    dst = F.when(F.col("link").startswith("//"), host_of(F.concat(F.lit("http:"), "link"))).otherwise(host_of(F.col("link")))
    return links.select("src", dst.alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def prepared(links: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves (src, host, p), each host's shares of those it hears from, and restarts (host, r, got) of ``seeds`` (host, weight from 0 to 1)."""
    into = links.groupBy("dst").agg(F.sum("n").alias("all"))
    moves = cut(links.join(into, "dst").select("src", F.col("dst").alias("host"), (F.col("n") / F.col("all")).alias("p")))
    fed = into.select(F.col("dst").alias("host"), F.lit(1 - DAMPING).alias("part"))
    restart = seeds.join(fed, "host", "left").select("host", (F.col("weight") * F.coalesce("part", F.lit(1.0))).alias("r"), F.lit(0.0).alias("got"))
    return moves, cut(restart)


def advanced(scores: DataFrame, moves: DataFrame, restart: DataFrame, steps: int) -> DataFrame:
    """(host, r, got) after so many steps more: ``got`` is the mean of what the host hears, ``r`` its score."""
    for _ in range(steps):
        moved = scores.withColumnRenamed("host", "src").join(moves, "src").select("host", (F.col("r") * F.col("p")).alias("got"))
        moved = moved.select("host", (F.col("got") * DAMPING).alias("r"), "got")
        scores = moved.unionByName(restart).groupBy("host").agg(F.sum("r").alias("r"), F.sum("got").alias("got"))
    return cut(scores)


def propagate(links: DataFrame, allowed: DataFrame, blocked: DataFrame, margin: float = LINK_MARGIN) -> DataFrame:
    """(host, trust, trust_in, distrust, distrust_out) from ``links`` (src, dst, n) and two kinds of seeds (host, weight from 0 to 1).

    A host's distrust is its personalised PageRank's share of blocked seeds: a walk from the host along its links, which goes on with
    probability DAMPING, ends there so often. Trust is the same against the links, of allowed seeds. For all hosts at once, both are found from the
    seeds: distrust goes to those that link to a host, trust to those it links to, and each host takes the mean of what it hears, so
    a seed's weight is not divided by the number of those that hear of it and hosts compare with one limit. ``distrust_out`` and ``trust_in`` are those means: what
    the host would be at most, were all its links like that. A host without links keeps its weight.

    Scores only grow, and after t steps none lacks more than DAMPING to the t. Steps go on until no host's difference of the means can still
    cross the margin, so their number decides nothing; it does not depend on the number of hosts.
    """
    sides = []
    for edges, seeds in ((links, allowed), (links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), blocked)):
        moves, restart = prepared(edges, seeds)
        sides.append([restart, moves, restart])
    lacking = 1.0 if all(part.limit(1).count() for part in (sides[1][0], sides[1][1])) else 0.0  # nothing to carry: all is decided
    while lacking > TOLERANCE:
        for side in sides:
            side[0] = advanced(*side, STEPS)
        lacking *= DAMPING**STEPS
        gap = F.coalesce("d.got", F.lit(0.0)) - F.coalesce("t.got", F.lit(0.0))
        met = sides[1][0].alias("d").join(sides[0][0].alias("t"), "host", "full")
        if lacking < margin and not met.where(F.abs(gap - margin) <= lacking).limit(1).count():
            break
    trust, distrust = (x[0].select("host", F.col("r").alias(name), F.col("got").alias(mean)) for x, name, mean in zip(sides, ("trust", "distrust"), ("trust_in", "distrust_out"), strict=True))
    return trust.join(distrust, "host", "full").na.fill(0.0)


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page.

    A rule that fits decides. Otherwise the page's host does: trust starts from hosts in proportion to their
    pages that rules allow and follows links; distrust starts from those that rules block and follows links
    backwards, to the hosts that link to them. A host is blocked if the distrust of those it links to exceeds the trust of those that link
    to it by more than LINK_MARGIN, or if rules block more of its pages than they allow by over MARGIN of all. Pages of other
    hosts, hosts unknown to rules and links and urls without a host among them, are allowed.
    Null urls and null html are empty ones; repeated rows are judged like any other; urls and pages are read whole, however long; of fitting
    rules of one length the last by name decides (two of one length that fit one url are equal); other columns are ignored; no pages give no rows.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    judged = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = cut(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")))
    links = cut(host_links(rows))
    seeds = lambda verdict: hosts.where(F.col(verdict) > 0).select("host", F.col(verdict).alias("weight"))
    scores = propagate(links, seeds("allow"), seeds("block")).join(hosts, "host", "full").na.fill(0.0)
    blocked = (F.col("distrust_out") - F.col("trust_in") > LINK_MARGIN) | (F.col("block") - F.col("allow") > MARGIN)
    scores = cut(scores.select("host", "trust", "distrust", blocked.alias("blocked")))
    joined = judged.select("page_id", "host", "path", "fit").join(scores, "host", "left")
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op7_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` of all ``pages``."""
    return judge(table(spark, sf_dir, "pages"))
