"""Helpers that several training-data operators share: cut points and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, spread, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one in few files is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def erase(table: DataFrame) -> None:
    """Deletes the files that ``written`` made for ``table``; other tables are left alone."""
    context = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        home = fs.makeQualified(context._jvm.org.apache.hadoop.fs.Path(shared_folder(table.sparkSession)))
        if fs.makeQualified(path).getParent().equals(home):
            fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint.

    Its files go with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on (Spark's default is off), at the latest
    with the application.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Edges that a task holds before it reduces them to a forest.
HELD = 1 << 20


def forest(batches):
    """Per task: spanning forests of the edges (a, b) that the task reads, root the smallest node."""
    held: list[np.ndarray] = []

    def flush():
        a, b = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)  # in order, so the smallest index is the smallest node
        root = label_pairs(len(nodes), at[: len(a)], at[len(a) :])
        ends = np.flatnonzero(root != np.arange(len(nodes)))
        return np.stack([nodes[root[ends]], nodes[ends]])

    def out(pairs):
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b")]))
        if sum(x.shape[1] for x in held) > HELD:
            held = [flush()]
            if held[0].shape[1] > HELD // 2:  # a forest of part of the edges keeps every connection
                yield out(held.pop())
    yield out(flush())


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star step over edges (a < b)."""
    both = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if not small:
        both = both.unionByName(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # The minima are cut off so that the join deals both sides anew: a hub with very many
    # neighbours is then a skewed join partition, which adaptive execution splits.
    least = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
    joined = both.join(least, "u")
    if small:
        out = joined.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        out = out.unionByName(least.where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return cut(out.where("a <> b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); root is the component's smallest node.

    Alternating large-star and small-star steps until every edge ends in a root. Every step is
    a shuffle by node after a map-side minimum; no component is ever held by one task.
    Empty edges give an empty result; loops and repeated edges change nothing.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(pairs.mapInArrow(forest, "a bigint, b bigint").distinct())
    while True:
        before = pairs
        pairs = _star(_star(pairs, small=False), small=True)
        changed = pairs.exceptAll(before).limit(1).count() + before.exceptAll(pairs).limit(1).count()
        if not changed:
            break
    roots = pairs.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
    return roots.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def label_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the index pairs (a, b), for each of n items."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b):  # the items themselves, and what they were labelled with
            np.minimum.at(new, ends, low)
            np.minimum.at(new, label[ends], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
