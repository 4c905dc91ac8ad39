"""A graph that lasts: new chunks are merged without the old ones, entities meet through aliases, and walks are exchangeable."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written
from .components import components
from .graph import DEPTH, both_ways, entities, relation_type, steps

#: Parts of the store by node, so that a lookup reads its own.
BUCKETS = 16
#: An extractor: chunks (chunk_id, text) to (chunk_id, label, type, confidence, pos), with ``aliases`` (array<string>) if it knows any.
Extractor = Callable[[DataFrame], DataFrame]
#: A traversal strategy: hits (query_id, label) and links (source, target, confidence) to steps (query_id, source, target, depth, confidence).
Traversal = Callable[[DataFrame, DataFrame], DataFrame]


def stem_alias(label: Column) -> Column:
    """The label's words in the singular, so that plurals meet."""
    return F.array(F.array_join(F.transform(F.split(label, " "), tx.stem), " "))


def with_stems(chunks: DataFrame) -> DataFrame:
    """The built-in extractor with ``stem_alias``."""
    return entities(chunks).withColumn("aliases", stem_alias(F.col("label")))


def mentions(chunks: DataFrame, extractors: Iterable[Extractor]) -> DataFrame:
    """What all extractors find, a row for each chunk and label: highest confidence, its type, first place, all aliases."""
    out = None
    for extract in extractors:
        found = extract(chunks)
        aliases = F.col("aliases") if "aliases" in found.columns else F.array().cast("array<string>")
        found = found.where(F.length(tx.trimmed("label")) > 0).select("chunk_id", F.lower(tx.collapsed("label")).alias("label"), "type", "confidence", "pos", aliases.alias("aliases"))
        out = found if out is None else out.unionByName(found)
    best = F.max_by("type", F.struct("confidence", -F.col("pos"))).alias("type")
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))))  # of one chunk and label
    return out.groupBy("chunk_id", "label").agg(best, F.max("confidence").alias("confidence"), F.min("pos").alias("pos"), union.alias("aliases"))


def resolved(named: DataFrame) -> DataFrame:
    """(label, entity) of rows (label, aliases): labels that share an alias, directly or through others, are one entity, named by the first of them.

    Labels and aliases are the two sides of a graph whose components are found by ``components``; an alias that is itself a label
    joins that too. A label without aliases is an entity of its own, and so is one whose aliases are no other label's: only what shares an alias goes on to
    the components' rounds.
    """
    labels = named.select("label", F.explode_outer("aliases").alias("alias"))
    same = labels.select("label", "alias").distinct().join(named.select(F.col("label").alias("alias")).distinct(), "alias").select(F.concat(F.lit("l:"), "label").alias("a"), F.concat(F.lit("l:"), "alias").alias("b"))
    edges = labels.select(F.concat(F.lit("l:"), "label").alias("a"), F.coalesce(F.concat(F.lit("z:"), "alias"), F.concat(F.lit("l:"), "label")).alias("b"))
    shared = edges.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low < high").select("b")
    roots = components(edges.join(shared, "b").select("a", "b").unionByName(same).distinct())
    met = roots.where(F.col("node").startswith("l:")).select(F.substring("node", 3, 1 << 30).alias("label"), F.substring("root", 3, 1 << 30).alias("entity"))
    alone = named.select("label").where("label is not null").distinct().join(met, "label", "left_anti")
    return met.unionByName(alone.select("label", F.col("label").alias("entity")))


def pairs(found: DataFrame, label: str = "label") -> DataFrame:
    """(source, target, chunks): names that meet in a chunk; made within the chunk's own array."""
    held = found.groupBy("chunk_id").agg(F.array_sort(F.collect_set(label)).alias("ls"))
    both = F.flatten(F.transform("ls", lambda a: F.transform(F.filter("ls", lambda b: b > a), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return held.select(F.explode(both).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("chunks"))


def bucket(label: Column) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(BUCKETS)).cast("int")


class GraphStore:
    """Nodes and edges under ``folder``, in parts by node and by the batch that brought them.

    ``merge`` extracts from new chunks only and adds their partial sums; a batch written twice is the same batch, so a failed merge is
    simply made again, and a chunk that is there already counts once. Readers add the parts up: numbers of chunks, highest confidences, all aliases. ``compact``
    makes one part of all without looking at chunks again.
    """

    def __init__(self, spark: SparkSession, folder: str, extractors: Iterable[Extractor] = (with_stems,)):
        self.spark, self.folder, self.extractors = spark, folder, list(extractors)

    def merge(self, chunks: DataFrame, batch: str) -> None:
        """Adds chunks (chunk_id, text). Repeated ids within the batch are one chunk."""
        new = chunks.dropDuplicates(["chunk_id"])
        if self._has("chunks"):
            known = self.spark.read.parquet(f"{self.folder}/chunks").where(F.col("batch") != batch)
            new = new.join(known.select("chunk_id").distinct(), "chunk_id", "left_anti")
        at = f"{self.folder}/mentions/batch={batch}"
        mentions(new, self.extractors).withColumn("bucket", bucket(F.col("label"))).write.mode("overwrite").partitionBy("bucket").parquet(at)
        found = self.spark.read.parquet(at)
        self._write(self._summed(found.withColumn("chunks", F.lit(1).cast("bigint"))), "nodes", "label", batch)
        self._write(pairs(found), "edges", "source", batch)
        new.select("chunk_id").write.mode("overwrite").parquet(f"{self.folder}/chunks/batch={batch}")  # last: from now on they are known

    def _summed(self, rows: DataFrame) -> DataFrame:
        best = F.max_by("type", F.struct("confidence", "type")).alias("type")
        aliases = F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases")  # different sets of one label
        return rows.groupBy("label").agg(best, F.max("confidence").alias("confidence"), F.sum("chunks").alias("chunks"), aliases)

    def _write(self, rows: DataFrame, kind: str, key: str, batch: str) -> None:
        rows.withColumn("bucket", bucket(F.col(key))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}/batch={batch}")

    def _has(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, kind: str, labels: list[str] | None, key: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{kind}")
        if labels is not None:  # their partitions only
            wanted = [r.b for r in self.spark.createDataFrame([(x,) for x in labels], "label string").select(bucket(F.col("label")).alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(wanted) & F.col(key).isin(labels))
        return rows

    def nodes(self, labels: list[str] | None = None) -> DataFrame:
        """(label, type, confidence, chunks, aliases), of a few labels or of all."""
        return self._summed(self._read("nodes", labels, "label"))

    def edges(self, sources: list[str] | None = None) -> DataFrame:
        """(source, target, type, chunks, confidence), of a few sources or of all."""
        met = self._read("edges", sources, "source").groupBy("source", "target").agg(F.sum("chunks").alias("chunks"))
        return met.select("source", "target", relation_type(F.col("source"), F.col("target")).alias("type"), "chunks", sureness(F.col("chunks")).alias("confidence"))

    def mentions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/mentions").drop("batch", "bucket")

    def entities(self) -> DataFrame:
        """(label, entity) through shared aliases."""
        return resolved(self.nodes().select("label", "aliases"))

    def traverse(self, hits: DataFrame, strategy: Traversal = steps) -> DataFrame:
        return strategy(hits, self.edges())

    def compact(self, batch: str = "compacted") -> None:
        """One part of nodes and edges in place of all: written whole beside them, then put in their place."""
        for kind, key, rows in (("nodes", "label", self._summed(self._read("nodes", None, "label"))), ("edges", "source", self._read("edges", None, "source").groupBy("source", "target").agg(F.sum("chunks").alias("chunks")))):
            rows.withColumn("bucket", bucket(F.col(key))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/.{kind}/batch={batch}")
            old, new = (self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}{kind}") for p in ("", "."))
            fs = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.delete(old, True)
            fs.rename(new, old)


def sureness(chunks: Column) -> Column:
    return tx.rounded(F.least(F.lit(1.0), 0.52 + 0.08 * (chunks - 1)), 6)


def strongest(width: int = 3, depth: int = DEPTH) -> Traversal:
    """A strategy that follows the strongest ways only: at each depth a query's ``width`` best new targets, by the product of confidences along the way."""

    def walk(hits: DataFrame, links: DataFrame) -> DataFrame:
        both = both_ways(links)
        seen = written(hits.select("query_id", "label").distinct(), "seen")
        front, out = seen.withColumn("way", F.lit(1.0)), None
        for level in range(1, depth + 1):
            met = front.join(both, "label").select("query_id", F.col("label").alias("source"), F.col("to").alias("target"), "confidence", (F.col("way") * F.col("confidence")).alias("way"))
            new = met.join(seen.withColumnRenamed("label", "target"), ["query_id", "target"], "left_anti")
            # Of several ways to a target the best, then the first source; then the best targets.
            one = Window.partitionBy("query_id", "target").orderBy(F.desc("way"), "source")
            best = new.withColumn("n", F.row_number().over(one)).where("n = 1")
            # Written: ``width`` rows a query at most, which Spark then knows to be few beside the edges.
            step = written(best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("way"), "target"))).where(F.col("n") <= width), "step")
            told = step.select("query_id", "source", "target", F.lit(level).alias("depth"), "confidence")
            out = told if out is None else out.unionByName(told)
            front = step.select("query_id", F.col("target").alias("label"), "way")
            seen = seen.unionByName(front.select("query_id", "label"))
        return out

    return walk
