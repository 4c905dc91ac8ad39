"""Token ids as Simple-8b files: written in document order, read back block by block."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import table, written
from .simple8b import decode, encode
from .tokens import default_vocabulary, encoder, texts_of

#: A container is closed after the document that brings it to so many ids.
CONTAINER_IDS = 1 << 18

CONTAINERS = (
    "shard int, seq int, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>,"
    " block_offsets array<bigint>, words binary"
)


def encode_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 2
) -> DataFrame:
    """The documents' ids as rows of ``CONTAINERS``, in ascending order of ``doc_id``.

    A range partitioning by id (ties by place in the input) makes each partition a shard whose documents follow
    those of the shard before; the ties part rows that share an id, or have none, among shards too. Null text is empty text and
    gives the end id alone; a null id sorts
    first; repeated rows are coded as often as they come; texts are coded whole, however long; other columns are ignored; an empty table
    gives no container. ``words`` are little-endian Simple-8b words.
    """
    path = vocabulary or default_vocabulary()

    def code(batches):
        words_of, shard, seq = encoder(path), TaskContext.get().partitionId(), 0
        end = words_of.packed([end_id])
        names, lengths, held, total = [], [], [], 0

        def container():
            ids = np.frombuffer(b"".join(held), words_of.kind).astype(np.uint64)
            words, first = encode(ids)
            row = [shard, seq, len(ids), list(names), list(lengths), first.tolist(), words.astype("<u8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            columns = ["shard", "seq", "n_ids", "doc_ids", "lengths", "block_offsets", "words"]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], columns)

        for batch in batches:
            for name, one in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                ids = words_of.encode(one) + end
                names.append(name)
                lengths.append(len(ids) // words_of.width)
                held.append(ids)
                total += len(ids) // words_of.width
                if total >= CONTAINER_IDS:
                    yield container()
                    seq, total = seq + 1, 0
                    names.clear(), lengths.clear(), held.clear()
        if names:
            yield container()

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(code, CONTAINERS)


def write_files(docs: DataFrame, path: str, **options) -> None:
    """Writes the containers of ``encode_documents`` under ``path``, on any file system Spark knows."""
    encode_documents(docs, **options).write.parquet(path)


def read_documents(containers: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from its container.

    ``start`` needs only the containers' sizes: totals by shard are summed first, so the one
    window without a key runs over as many rows as there are shards.
    """

    def digest(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first = np.array(row["block_offsets"], np.int64)
                ids = decode(np.frombuffer(row["words"], "<u8"), first, row["n_ids"]).astype("<u4").tobytes()
                at = 0
                for name, n in zip(row["doc_ids"], row["lengths"], strict=True):
                    out.append((row["shard"], row["seq"], name, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                    at += n
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
            names = ["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    sizes = containers.select("shard", "seq", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before.orderBy("shard")), F.lit(0)).alias("shard_base"))
    inside = F.coalesce(F.sum("n_ids").over(before.partitionBy("shard").orderBy("seq")), F.lit(0))
    bases = sizes.select("shard", "seq", inside.alias("base")).join(shards, "shard")
    documents = containers.select("shard", "seq", "n_ids", "doc_ids", "lengths", "block_offsets", "words")
    digests = documents.mapInArrow(digest, "shard int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return digests.join(bases, ["shard", "seq"]).select(
        "doc_id", (F.col("shard_base") + F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def op2_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded, written as containers, and read back from them."""
    docs = table(spark, sf_dir, "documents")
    return read_documents(written(encode_documents(docs), "token-ids"))
