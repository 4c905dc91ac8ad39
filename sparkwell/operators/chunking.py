"""Sections of documents and overlapping chunks of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, let, trimmed


#: A blank line's line ends. Possessive: Java runs it as a loop, where a greedy group would take a stack frame for each line end.
GAP = r"(?:\r?\n){2,}+"
#: Sums run within blocks of so many, then over blocks, since an array grows by copying.
SUMMED = 512


def running(lengths: Column) -> Column:
    """The sum of what stands before each member of an array of ints, within the row."""

    def before(values: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("sums"), F.lit(0).alias("at"))
        return F.aggregate(values, start, lambda s, x: F.struct(F.concat(s["sums"], F.array(s["at"])).alias("sums"), (s["at"] + x).alias("at")))

    def of(values: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(SUMMED))
        return let(F.transform(firsts, lambda i: before(F.slice(values, i, F.lit(SUMMED)))), over)

    def over(blocks: Column) -> Column:
        starts = before(F.transform(blocks, lambda b: b["at"]))["sums"]
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b["sums"], lambda x: x + s)))

    return let(lengths, of)


def sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section_id, section_no, text, start_offset) of the paragraphs between blank lines.

    Offsets are of the trimmed paragraph in the document; blank paragraphs take no number.
    """
    parts, gaps = F.split(F.col(text), GAP), F.regexp_extract_all(F.col(text), F.lit(GAP), 0)
    placed = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), parts.alias("parts"), gaps.alias("gaps"))
    lengths = F.transform(F.arrays_zip("parts", "gaps"), lambda p: F.length(p["parts"]) + F.coalesce(F.length(p["gaps"]), F.lit(0)))
    walked = F.zip_with("parts", running(lengths), lambda p, at: F.struct(p.alias("text"), at.alias("start")))
    whole = F.when(F.size("parts") == 1, F.array(F.struct(F.col("parts")[0].alias("text"), F.lit(0).alias("start")))).otherwise(walked)
    kept = F.filter(whole, lambda p: F.length(trimmed(p["text"])) > 0)
    out = placed.select("doc_id", F.posexplode(kept).alias("n", "p"))
    lead = F.length("p.text") - F.length(F.ltrim(F.col("p.text"), F.lit(BLANKS)))
    return out.select(
        "doc_id", F.concat(F.lit("section-"), (F.col("n") + 1).cast("string")).alias("section_id"), (F.col("n") + 1).alias("section_no"),
        trimmed("p.text").alias("text"), (F.col("p.start") + lead).alias("start_offset"),
    )


def chunks(parts: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before, trimmed.

    A window that is blank takes no number. ``parts`` is what ``sections`` gives. The number in the
    section comes with the explode, so nothing is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")
    step = size - overlap
    last = (F.ceil(F.greatest(F.length("text") - size, F.lit(0)) / step) * step).cast("int")
    slices = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.struct(s.alias("at"), F.substring(F.col("text"), s + 1, F.lit(size)).alias("slice")))
    kept = F.filter(slices, lambda s: F.length(trimmed(s["slice"])) > 0)
    out = parts.select("doc_id", "section_id", "section_no", "start_offset", F.posexplode(kept).alias("n", "s"))
    lead = F.length("s.slice") - F.length(F.ltrim(F.col("s.slice"), F.lit(BLANKS)))
    start = F.coalesce("start_offset", F.lit(0)) + F.col("s.at") + lead
    text = trimmed("s.slice")
    return out.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), "section_id", F.concat(F.lit("chunk-"), (F.col("n") + 1).cast("string"))).alias("chunk_id"),
        "doc_id", "section_id", "section_no", (F.col("n") + 1).alias("section_chunk_index"), text.alias("text"),
        start.alias("start_offset"), (start + F.length(text)).alias("end_offset"),
        F.when(F.col("start_offset").isNotNull(), "document").otherwise("section").alias("offset_basis"),
    )
