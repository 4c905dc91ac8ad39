"""Documents to packed sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm import language_id, toxicity
from sparkwell.llm.common import erase, written
from sparkwell.llm.decontaminate import text_key, text_matches
from sparkwell.llm.packing import pack
from sparkwell.llm.shingles import near_copies
from sparkwell.llm.simhash import followers

#: A document of no language goes: one whose largest share is less, or whose languages explain it no better than chance.
LEAST_SHARE = 0.5


def whole(docs: DataFrame) -> DataFrame:
    """(doc): each row as one struct, so that no column that a stage adds meets one of the documents'."""
    return docs.select(F.struct("*").alias("doc"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go.

    Those are null texts and texts without letters, texts of which no language has LEAST_SHARE, and texts that the languages found explain no
    better than evenly spread n-grams would, if they have n-grams enough to tell. Without any labelled text, only those without
    letters go. Rows stand for themselves: null or repeated ids, repeated rows and other columns, of whatever name, stay as they are.
    """
    model = language_id.train(language_id.labelled_rows(docs))
    if not model[0]:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = whole(docs)
    judged = rows.withColumn("found", language_id.judged(rows, model, "doc.text"))
    known = (F.col("found.lang_pred") != language_id.UNKNOWN) & (F.col("found.score") >= LEAST_SHARE)
    return judged.where(known & F.coalesce(F.col("found.surplus") > 0, F.lit(True))).select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model finds toxic go.

    Without labels of both kinds none does. Rows stand for themselves, as in the stage before; null texts stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.labelled_rows(docs, labels))
    rows = whole(docs)
    return rows.where(toxicity.chance(rows, model, "doc.text") < toxicity.THRESHOLD).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Groups are those of SimHash; of what they leave, texts whose five-word shingles overlap by 0.8 or more, compared exactly, are groups too.
    Rows are numbered once and kept by number: an id that repeats or is null neither keeps nor takes away a row whose text is
    like no other. Null ids come last, then the first row stays. Texts without words are one group. What goes is few, so it is that which the
    documents are joined with.
    """
    rows = written(whole(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    plain = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    alike = written(followers(plain, row="row"), "alike")
    gone = alike.unionByName(near_copies(plain.join(alike, "row", "left_anti"), row="row"))
    # Written, so that its size is known when Spark chooses between a broadcast and a shuffle of the documents.
    return rows.join(written(gone, "copies"), "row", "left_anti").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, verbatim or with its slots filled otherwise, go.

    The text alone decides, so rows with null or repeated ids are judged each by its own; null texts stay, and without items all do.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(text_key(F.col("text")).alias("key"), "text")
    keyed = whole(docs).withColumn("key", text_key(F.col("doc.text")))
    found = text_matches(keyed.select("key", F.col("doc.text").alias("text")), items).select("key").distinct()
    # Written, so that its size is known when Spark chooses between a broadcast and a shuffle of the documents.
    return keyed.join(written(found, "contaminated"), "key", "left_anti").select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences; a row for each piece, digest in place of ids. Null texts are empty, rows stand for themselves."""
    return pack(docs, digest=True)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: SQL can express neither the learned models nor the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Each one's table goes when the next is written; the last reads the one before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            erase(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
