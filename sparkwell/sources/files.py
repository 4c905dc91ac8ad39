"""Sources and sinks on any file system that Spark reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

GOLDEN = "id string, question string, context string, expectedAnswer string, expectedChunkIds array<string>, metadata map<string,string>"
TRACE = (
    "version string, timestamp string, component string, operation string, status string, durationMs double, provider string, model string,"
    " correlation map<string,string>, metadata map<string,string>, error struct<message:string>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, sha256) of whole text files."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of PDF pages that are not blank; needs the pypdf library on the executors."""
    import pandas as pd

    def pages(batches):
        import io

        from pypdf import PdfReader

        for pdf in batches:
            rows = [(p, i, t.strip()) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, t in enumerate((x.extract_text() or "" for x in PdfReader(io.BytesIO(c)).pages), 1)]
            yield pd.DataFrame([x for x in rows if x[2]], columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, page int, text string")


def inline_texts(spark: SparkSession, contents: list[tuple[str, str]]) -> DataFrame:
    """(path, text, sha256) of texts given with their names, as ``read_texts`` gives those of files."""
    rows = spark.createDataFrame(contents, "path string, text string")
    return rows.withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))


def page_sections(pages: DataFrame) -> DataFrame:
    """(path, section_id, page, text, start_offset, end_offset) of pages (path, page, text): offsets in the pages' texts joined by a blank line.

    Pages are trimmed, blank ones dropped. Offsets are sums over a document's pages before.
    """
    kept = pages.select("path", "page", trimmed("text").alias("text")).where(F.length("text") > 0)
    before = Window.partitionBy("path").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    placed = kept.withColumn("start_offset", start)
    return placed.select("path", F.concat(F.lit("page-"), F.col("page").cast("string")).alias("section_id"), "page", "text", "start_offset", (F.col("start_offset") + F.length("text")).alias("end_offset"))


def unsupported(kind: str) -> Callable[..., DataFrame]:
    def refuse(*_: object) -> DataFrame:
        raise NotImplementedError(f"{kind} extraction is not implemented")

    return refuse


#: Readers by modality.
READERS: dict[str, Callable[..., DataFrame]] = {"text": read_texts, "pdf": read_pdf, "image": unsupported("image"), "audio": unsupported("audio")}


def ingest(spark: SparkSession, modality: str, path: str) -> DataFrame:
    """The documents of a path by the reader for their modality."""
    if modality not in READERS:
        raise ValueError(f"no reader for {modality}")
    return READERS[modality](spark, path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, sha256) of a dataset registry's entries."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("datasets").alias("d")).select("d.id", "d.path", "d.sha256")


def verify(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Adds to registry entries whether a file with their checksum is there."""
    have = files.select(F.col("sha256").alias("found"), F.lit(True).alias("there")).distinct()
    return entries.join(have, entries["sha256"] == have["found"], "left").select("id", "path", F.coalesce("there", F.lit(False)).alias("verified"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a golden set; no expected chunks is an empty array."""
    whole = spark.read.schema(f"name string, version string, entries array<struct<{GOLDEN.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map')}>>").option("multiLine", True).json(path)
    entry = whole.select(F.explode("entries").alias("e")).select("e.*")
    return entry.withColumn("expectedChunkIds", F.coalesce("expectedChunkIds", F.array().cast("array<string>")))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace records of JSON lines; lines that are no JSON or lack a component, operation or status are skipped, bad durations are 0."""
    rows = spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)
    good = rows.where("component is not null and operation is not null and status is not null")
    duration = F.when(F.isnan("durationMs") | (F.col("durationMs") < 0), 0.0).otherwise(F.coalesce("durationMs", F.lit(0.0)))
    return good.withColumn("durationMs", duration)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_index(chunks: DataFrame, path: str) -> None:
    """Replaces the documents' own partitions of an index and no others; ``chunks`` has tenant, owner and doc_id."""
    chunks.repartition("tenant", "owner", "doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant", "owner", "doc_id").parquet(path)


def load_index(spark: SparkSession, path: str, tenant: str, owner: str) -> DataFrame:
    """What a tenant's user may see; only those partitions are read."""
    return spark.read.parquet(path).where((F.col("tenant") == tenant) & (F.col("owner") == owner))


def session_file(session_id: Column) -> Column:
    """A session id as a safe file name."""
    return F.regexp_replace(session_id, "[^A-Za-z0-9_-]", "_")


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", version: str = "updated_at") -> DataFrame:
    """The newest row of each key, of both frames."""
    both = stored.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("r")).select("r.*")


def blank_free(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(F.length(trimmed(text)) > 0)


#: An execution snapshot: what was asked, what was found, and how, so that it can be run again.
SNAPSHOT = (
    "id string, createdAt string, query string, documentId string, params map<string,string>, provider string,"
    " chunks array<struct<chunkId:string,rank:int,score:double,textHash:string,preview:string>>, answer string"
)


def complete(snapshots: DataFrame) -> Column:
    """Whether a snapshot has all that a replay needs."""
    chunk = lambda c: c["chunkId"].isNotNull() & c["score"].isNotNull() & (F.length(c["textHash"]) == 64)
    named = F.col("id").isNotNull() & (F.length("query") > 0) & F.col("documentId").isNotNull() & F.col("answer").isNotNull()
    return F.coalesce(named & (F.size("chunks") > 0) & F.forall("chunks", chunk), F.lit(False))


def save_snapshots(snapshots: DataFrame, path: str) -> None:
    """Appends snapshots as JSON lines; incomplete ones are an error."""
    bad = F.raise_error(F.concat(F.lit("incomplete snapshot "), F.coalesce("id", F.lit("without id"))))
    snapshots.select(F.when(complete(snapshots), F.struct(*snapshots.columns)).otherwise(bad.cast(snapshots.select(F.struct(*snapshots.columns)).dtypes[0][1])).alias("s")).select("s.*").write.mode("append").json(path)


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Complete snapshots of JSON lines."""
    rows = spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path)
    return rows.where(complete(rows))


def list_index(spark: SparkSession, path: str, tenant: str, owner: str) -> DataFrame:
    """(doc_id, chunks) of what a tenant's user has in an index."""
    return load_index(spark, path, tenant, owner).groupBy("doc_id").agg(F.count("*").alias("chunks"))
