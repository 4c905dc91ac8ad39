"""Connected components over names, by built-in operators alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: string): the smallest name that edges reach.

    Each round takes the smallest root among a node's neighbours and then that root's own, so rounds grow with the logarithm of the longest
    way. A round is joins and minima that Spark makes before it shuffles; a hub is a skewed join that it splits. Null ends are left out,
    loops are nodes of their own, and no edges give no nodes.
    """
    real = edges.where("a is not null and b is not null").select("a", "b")
    both = checkpointed(real.unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    named = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(named, both["b"] == named["node"]).groupBy("a").agg(F.min("root").alias("near"))
        met = named.join(near, named["node"] == near["a"], "left").select("node", "root", F.least("root", "near").alias("new"))
        far = named.select(F.col("node").alias("new"), F.col("root").alias("far"))
        new = checkpointed(met.join(far, "new", "left").select("node", "root", F.least("new", "far").alias("new")))
        if not new.where("new <> root").limit(1).count():
            return named
        named = new.select("node", F.col("new").alias("root"))
