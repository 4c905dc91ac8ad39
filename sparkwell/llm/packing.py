"""Packing by minimum bin slack over the histogram of remaining lengths."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import table, written
from .tokens import default_vocabulary, encoder, texts_of

SEQUENCE = 2048
#: Bits of a row's number that count the rows of its input partition.
PART_BITS = 40
#: Plans of up to so many rows are broadcast (under 4 MB); larger ones are joined by shuffle, on stretches of so many remainders of a length.
BROADCAST_ROWS, STRETCH = 20_000, 4096

SEGMENTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("rest", "lo", "hi", "skip", "length", "place", "first_sequence", "per_sequence", "first_offset")]
)


def fullest(counts: dict[int, int], room: int) -> Counter:
    """The sub-multiset of lengths, the longest one in it, whose sum comes closest to ``room``.

    Subset sums are the bits of an integer: copies of a length are added in powers of two, and
    the bits before each addition are kept, from which the counts are found again backwards.
    """
    longest = max(counts)
    chosen = Counter({longest: 1})
    room -= longest
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length if length <= room else 0)
        copies = 1
        while left > 0:
            copies = min(copies, left)
            steps.append((length, copies, sums))
            sums |= (sums << (length * copies)) & mask
            left -= copies
            copies *= 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += copies
            at -= length * copies
    return chosen


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> tuple[list[tuple], int]:
    """Segments that place every remainder, and how many sequences they fill.

    The histogram (count by remaining length, 1 to size - 1) is all that this needs, so the work does not
    grow with the documents: a filling is repeated for as long as its lengths last.
    A filling that leaves slack gets it from the start of one more remainder, whose end goes back
    among the remainders. The last sequence is cut at powers of two, which need no padding.

    A segment says that of the remainders of length ``rest`` those numbered lo..hi-1 put the part
    [skip, skip + length) into the places from ``place`` on; there are ``per_sequence`` places in a sequence,
    ``length`` apart from ``first_offset`` on, and the first sequence is ``first_sequence``.
    """
    # By length: runs (rest, skip, lo, hi) of remainders, or of their ends, that are this long.
    runs = {n: [(n, 0, 0, c)] for n, c in histogram.items() if c}
    left = {n: c for n, c in histogram.items() if c}
    segments: list[tuple] = []
    sequences = 0

    def take(length: int, many: int, part: int, first: int, per: int, offset: int) -> list[tuple]:
        """Puts the starts, ``part`` long, of ``many`` remainders of a length into places; returns their runs."""
        taken, place = [], 0
        left[length] -= many
        if not left[length]:
            del left[length]
        while place < many:
            rest, skip, lo, hi = runs[length].pop()
            n = min(many - place, hi - lo)
            segments.append((rest, lo, lo + n, skip, part, place, first, per, offset))
            taken.append((rest, skip + part, lo, lo + n))
            if lo + n < hi:
                runs[length].append((rest, skip, lo + n, hi))
            place += n
        return taken

    while left:
        if sum(n * min(c, size) for n, c in left.items()) < size:
            break
        chosen = fullest(left, size)
        slack = size - sum(n * k for n, k in chosen.items())
        times = min(left[n] // k for n, k in chosen.items())
        cut = None
        if slack:
            # Every other remainder is longer than the slack, or it would have been chosen.
            others = [n for n in left if n > slack and left[n] > chosen[n]]
            cut = max(others)
            times = min(times, left[cut] // (chosen[cut] + 1))
        offset = 0
        for length, k in sorted(chosen.items(), reverse=True):
            take(length, k * times, length, sequences, k, offset)
            offset += length * k
        if cut:
            for rest, skip, lo, hi in take(cut, times, slack, sequences, 1, offset):
                runs.setdefault(cut - slack, []).append((rest, skip, lo, hi))
                left[cut - slack] = left.get(cut - slack, 0) + hi - lo
        sequences += times

    # Less than one sequence is left: a few remainders, cut to powers of two.
    last = [(rest, n, k) for n in sorted(left, reverse=True) for rest, skip, lo, hi in runs[n] for k in range(lo, hi)]
    total = sum(n for _, n, _ in last)
    room = offset = 0
    for rest, n, k in last:
        skip = rest - n
        while n:
            if not room:
                room, offset = 1 << (total.bit_length() - 1), 0
                sequences += 1
            part = min(n, room)
            segments.append((rest, k, k + 1, skip, part, 0, sequences - 1, 1, offset))
            skip, n, room, offset, total = skip + part, n - part, room - part, offset + part, total - part
    return segments, sequences


def encode_rows(docs: DataFrame, *, doc_id: str, text: str, vocabulary: str | None, end_id: int) -> DataFrame:
    """(row, doc_id, n, ids): a number for every row, its id, and its ids in as few bytes as the vocabulary needs."""
    path = vocabulary or default_vocabulary()

    def code(batches):
        words_of = encoder(path)
        row = TaskContext.get().partitionId() << PART_BITS
        end = words_of.packed([end_id])
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for at in range(0, len(names), 500):
                ids = [words_of.encode(x) + end for x in texts_of(batch.slice(at, 500), "text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + len(ids)), pa.int64()), pa.array(names[at : at + 500], pa.int64()),
                        pa.array([len(x) // words_of.width for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    ["row", "doc_id", "n", "ids"],
                )
                row += len(ids)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(code, "row bigint, doc_id bigint, n bigint, ids binary")


def _part(row: str) -> Column:
    """The input partition in which ``encode_rows`` met a row."""
    return F.shiftright(row, PART_BITS)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds to the rows of each ``rest`` the numbers 0, 1, ... in no order that matters.

    They are counted by input partition first, so a length that most documents share is no hot key: no task numbers
    more of its rows than one partition held.
    """
    salted = rows.withColumn("salt", _part("row"))
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("rest", "salt").agg(F.count("*").alias("c"))
    bases = bases.select("rest", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rest", "salt").orderBy("row")
    ranked = salted.withColumn("nth", F.row_number().over(inside) - 1)
    return ranked.join(bases, ["rest", "salt"]).withColumn("nth", F.col("nth") + F.col("base")).drop("salt", "base")


def joined_plan(remainders: DataFrame, placed: DataFrame, small: bool) -> DataFrame:
    """Each remainder with the segments that hold it.

    Beyond a broadcast, both sides meet by length and stretch of numbers, so a length that most documents share is dealt to many tasks,
    and its remainders meet the segments of their stretch only.
    """
    inside = (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi"))
    if small:
        return remainders.join(F.broadcast(placed), "rest").where(inside)
    stretches = F.sequence(F.floor(F.col("lo") / STRETCH), F.floor((F.col("hi") - 1) / STRETCH))
    placed = placed.withColumn("stretch", F.explode(stretches))
    return remainders.withColumn("stretch", F.floor(F.col("nth") / STRETCH)).join(placed, ["rest", "stretch"]).where(inside).drop("stretch")


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1, size: int = SEQUENCE, digest: bool = False
) -> DataFrame:
    """Every document's pieces: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A document's whole windows of ``size`` ids are sequences of their own; what remains is placed by
    ``plan``. Every sequence is full, but for at most log2(size) last ones whose lengths are powers of two.
    Null text is empty and gives the end id alone. Rows are told apart by their place, so null or repeated
    ids and equal rows are packed like any others, texts whole however long, other columns ignored. An empty table gives no piece. ``ids`` are
    little-endian, two bytes each for vocabularies of up to 65,536 ids and four bytes otherwise; with ``digest``, their crc32
    as four-byte integers takes their place.
    """
    spark = ship(docs.sparkSession)
    tokens = written(encode_rows(docs, doc_id=doc_id, text=text, vocabulary=vocabulary, end_id=end_id), "packing-ids")
    sizes = tokens.select("row", "n", F.floor(F.col("n") / size).alias("whole"), (F.col("n") % size).alias("rest"))

    # At most size - 1 rows, whatever the corpus.
    histogram = {r.rest: r.c for r in sizes.where("rest > 0").groupBy("rest").agg(F.count("*").alias("c")).collect()}
    segments, filled = plan(histogram, size)
    remainders = joined_plan(_numbered(sizes.where("rest > 0")), spark.createDataFrame(segments, SEGMENTS), small=len(segments) <= BROADCAST_ROWS)
    i = F.col("nth") - F.col("lo") + F.col("place")
    small = remainders.select(
        "row", (F.col("whole") * size + F.col("skip")).alias("start"), "length",
        (F.col("first_sequence") + F.floor(i / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + (i % F.col("per_sequence")) * F.col("length")).alias("offset"),
    )
    # Whole windows are numbered after the planned sequences: by input partition, then inside each.
    long = sizes.where("whole > 0").withColumn("part", _part("row"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = long.groupBy("part").agg(F.sum("whole").alias("c"))
    bases = bases.select("part", F.coalesce(F.sum("c").over(upto(Window.orderBy("part"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("whole").over(upto(Window.partitionBy("part").orderBy("row"))), F.lit(0))
    long = long.withColumn("inside", inside).join(bases, "part")
    windows = long.select("row", (F.col("base") + F.col("inside") + filled).alias("first"), F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("w")).select(
        "row", (F.col("w") * size).alias("start"), F.lit(size).cast("bigint").alias("length"),
        (F.col("first") + F.col("w")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
    pieces = small.unionByName(windows).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def slice_ids(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield _pieces(batch.slice(at, 500), digest)

    last = "ids_crc32 bigint" if digest else "ids binary"
    schema = f"doc_id bigint, start bigint, length bigint, {last}, doc_tokens bigint, sequence_id bigint, offset bigint"
    return tokens.join(pieces, "row").select("doc_id", "n", "ids", "pieces").mapInArrow(slice_ids, schema)


def _pieces(batch: pa.RecordBatch, digest: bool) -> pa.RecordBatch:
    out = []
    for row in batch.to_pylist():
        ids, width = row["ids"], len(row["ids"]) // row["n"]
        if digest and width == 2:
            ids, width = np.frombuffer(ids, "<u2").astype("<u4").tobytes(), 4
        for p in row["pieces"]:
            part = ids[p["start"] * width : (p["start"] + p["length"]) * width]
            out.append((row["doc_id"], p["start"], p["length"], zlib.crc32(part) if digest else part, row["n"], p["sequence_id"], p["offset"]))
    columns = list(zip(*out, strict=True)) or [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def op4_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048 ids, with a digest in place of each piece's ids."""
    return pack(table(spark, sf_dir, "documents"), digest=True)
