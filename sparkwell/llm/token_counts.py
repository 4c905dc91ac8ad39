"""Exact histogram of encoded lengths, from which every context limit is answered."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, table
from .tokens import default_vocabulary, encoder, texts_of


def encoded_lengths(docs: DataFrame, *, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Documents by encoded length: (length, n_docs). Null text counts as empty, of length 0.

    Each task sums its own documents first, so what is shuffled is a row for each length and task. Repeated rows count as often as they
    come, texts are encoded whole however long, other columns are ignored, and an empty table gives no row.
    """
    path = vocabulary or default_vocabulary()

    def count(batches):
        words_of, seen = encoder(path), {}
        for batch in batches:
            for one in texts_of(batch, "text"):
                n = len(words_of.encode(one)) // words_of.width
                seen[n] = seen.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n"]
        )

    ship(docs.sparkSession)
    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "length bigint, n bigint")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def length_report(lengths: DataFrame, *, band: int = 256) -> DataFrame:
    """One row for every length that occurs, taken as a context limit.

    ``n_docs`` documents have just this length, ``docs_over`` are longer and lose
    ``tokens_cut`` tokens, ``tokens_kept`` remain of all documents cut to this limit;
    ``share_within`` is the share of documents that fit, so the p-quantile of the lengths is the first
    length whose share reaches p. Between two rows the kept tokens grow by
    ``docs_over`` of the smaller one for each token of the limit. Sums run from the longest
    length down: over bands of ``band`` lengths, then inside each band. No documents: no rows.
    """
    banded = lengths.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / band).alias("band"))
    over = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    totals = banded.groupBy("band").agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("t"))
    # A row for each band of lengths: few, however many documents there are.
    longer = over(Window.orderBy(F.desc("band")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "band",
        F.coalesce(F.sum("n").over(longer), none).alias("n_above"), F.coalesce(F.sum("t").over(longer), none).alias("t_above"),
        F.sum("n").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"),
    )
    inside = over(Window.partitionBy("band").orderBy(F.desc("length")))
    rows = banded.join(totals, "band").select(
        "length", "n_docs", "all_docs", "all_tokens",
        (F.col("n_above") + F.coalesce(F.sum("n_docs").over(inside), none)).alias("docs_over"),
        (F.col("t_above") + F.coalesce(F.sum("tokens").over(inside), none)).alias("tokens_over"),
    )
    lost = F.col("tokens_over") - F.col("length") * F.col("docs_over")
    return rows.select(
        F.col("length").alias("context_limit"), "n_docs", "docs_over", "all_docs", "all_tokens",
        lost.alias("tokens_cut"), (F.col("all_tokens") - lost).alias("tokens_kept"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_within"),
    )


def quantile(report: DataFrame, p: float) -> DataFrame:
    """The smallest length that at least a share ``p`` of the documents does not exceed."""
    return report.where(F.col("share_within") >= p).agg(F.min("context_limit").alias("length"))


def truncated_total(report: DataFrame, limit: int) -> DataFrame:
    """Tokens that remain when every document is cut to ``limit``, for any limit from 0 up."""
    row = F.struct("context_limit", "tokens_kept", "docs_over")
    one = report.agg(F.max(F.when(F.col("context_limit") <= limit, row)).alias("r"), F.max("all_docs").alias("n"))
    grown = F.col("r.tokens_kept") + F.col("r.docs_over") * (F.lit(limit) - F.col("r.context_limit"))
    # Below the shortest document, each of them fills the limit.
    return one.select(F.coalesce(grown, F.col("n") * F.lit(limit), F.lit(0)).alias("tokens"))


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``length_report`` of all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return length_report(cut(encoded_lengths(docs)))  # the report reads the lengths twice


