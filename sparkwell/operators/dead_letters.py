"""Dead letters driven again: what is scheduled leaves the store, what fails stays with one attempt more, and an audit keeps every try."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A letter of the store; it is partitioned by job type and by the batch that filed it.
LETTER = "job_id string, payload string, attempts int, not_before_ms bigint, error string, failed_at_ms bigint, job_type string, batch bigint"
AUDIT = "job_id string, job_type string, batch bigint, status string, reason string, new_job_id string, attempts_before int, redriven_at_ms bigint, redriven_by string"
KEY = ["job_id", "job_type", "batch"]


def outcomes(letters: DataFrame, refused: Column, *, dry: Column | bool = False) -> DataFrame:
    """``letters`` with ``status`` (dry-run, failed or scheduled), ``reason``, ``new_job_id`` and ``attempts_after`` (null: it leaves the store).

    ``refused`` is why a letter cannot be queued again, null if it can; ``dry`` marks those that are only looked at.
    A letter's new job is named by its id and its attempts, so the same try twice makes one job. Letters without an id get one by their payload.
    """
    dry = dry if isinstance(dry, Column) else F.lit(dry)
    status = F.when(dry, "dry-run").when(refused.isNotNull(), "failed").otherwise("scheduled")
    attempts = F.coalesce(F.col("attempts"), F.lit(0))
    name = F.substring(F.sha2(F.concat_ws(":", F.coalesce("job_id", "payload"), attempts.cast("string")), 256), 1, 16)
    out = letters.withColumns({"status": status, "_refused": refused})
    return out.withColumns({
        "reason": F.when(F.col("status") == "dry-run", F.coalesce(F.concat(F.lit("would fail: "), F.col("_refused")), F.lit("validation passed"))).otherwise(F.col("_refused")),
        "new_job_id": F.when(F.col("status") == "scheduled", name),
        "attempts_after": F.when(F.col("status") == "failed", attempts + 1).when(F.col("status") == "dry-run", attempts),
    }).drop("_refused")


def letters(spark: SparkSession, folder: str, job_type: str | None = None) -> DataFrame:
    """The store's letters, of one job type if it is named: then only its partitions are read."""
    if not _exists(spark, f"{folder}/dead"):
        return spark.createDataFrame([], LETTER)
    found = spark.read.schema(LETTER).parquet(f"{folder}/dead")
    return found if job_type is None else found.where(F.col("job_type") == job_type)


def redrive(
    spark: SparkSession, folder: str, run: str, send: Callable[[DataFrame, str], None], *, now_ms: int, refused: Column | None = None, job_type: str | None = None,
    chosen: Column | None = None, dry_run: bool = False, by: str | None = None,
) -> DataFrame:
    """The audit rows (AUDIT) of driving the store's letters again, those that are ``chosen`` if a condition is given.

    ``send`` puts the scheduled ones (job_id, job_type, payload, attempts 0, not_before_ms) into a queue under a token, which the queue takes once. ``run`` names the try:
    its audit is written first and decides from then on, so that a run that ended half-way and is started again sends nothing twice, counts no attempt
    twice and loses no letter. Only partitions with letters of the run are rewritten, from a copy that is whole before they are. A dry run
    writes its audit and nothing else.
    """
    audit_at = f"{folder}/audit/run={run}"
    if not _exists(spark, f"{audit_at}/_SUCCESS"):
        picked = letters(spark, folder, job_type)
        picked = picked if chosen is None else picked.where(chosen)
        judged = outcomes(picked, F.lit(None).cast("string") if refused is None else refused, dry=dry_run)
        rows = judged.select(
            *KEY, "status", "reason", "new_job_id", F.coalesce("attempts", F.lit(0)).alias("attempts_before"), F.lit(now_ms).cast("bigint").alias("redriven_at_ms"),
            F.lit(by).cast("string").alias("redriven_by"), "payload",
        )
        rows.write.mode("overwrite").parquet(audit_at)
    audit = spark.read.parquet(audit_at)
    if not dry_run:
        scheduled = audit.where("status = 'scheduled'")
        send(scheduled.select(F.col("new_job_id").alias("job_id"), "job_type", "payload", F.lit(0).alias("attempts"), F.lit(0).cast("bigint").alias("not_before_ms")), f"redrive-{run}")
        _rewrite(spark, folder, run, audit)
    return audit.drop("payload")


def _rewrite(spark: SparkSession, folder: str, run: str, audit: DataFrame) -> None:
    touched = audit.select("job_type", "batch").distinct()
    held = letters(spark, folder).join(touched, ["job_type", "batch"], "left_semi")
    # Repeated rows of a letter share its fate; attempts are what the audit says, not what the store has by now.
    fates = audit.groupBy(*KEY).agg(F.max("status").alias("status"), F.max("attempts_before").alias("before"))
    known = [F.col(f"l.{k}").eqNullSafe(F.col(f"f.{k}")) for k in KEY]
    kept = held.alias("l").join(fates.alias("f"), known, "left").where("status is null or status <> 'scheduled'")
    attempts = F.when(F.col("status") == "failed", F.col("before") + 1).otherwise(F.col("attempts")).cast("int").alias("attempts")
    copy = f"{folder}/rewriting/run={run}"
    order = [c.split()[0] for c in LETTER.split(", ")]
    kept.select(*[attempts if c == "attempts" else F.col(f"l.{c}") for c in order]).write.mode("overwrite").parquet(copy)
    rewritten = spark.read.schema(LETTER).parquet(copy)
    rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_type", "batch").parquet(f"{folder}/dead")
    # A partition that nothing is left of is not overwritten but goes.
    empty = touched.join(rewritten.select("job_type", "batch").distinct(), ["job_type", "batch"], "left_anti")
    for row in empty.toLocalIterator():  # partitions, not letters
        _delete(spark, f"{folder}/dead/job_type={row.job_type}/batch={row.batch}")
    _delete(spark, copy)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(job_type, total, successful, failed, dry) of all tries, and a row for all job types (null)."""
    if not _exists(spark, f"{folder}/audit"):
        return spark.createDataFrame([], "job_type string, total bigint, successful bigint, failed bigint, dry bigint")
    audit = spark.read.parquet(f"{folder}/audit")
    of = lambda s: F.count_if(F.col("status") == s)
    return audit.rollup("job_type").agg(F.count("*").alias("total"), of("scheduled").alias("successful"), of("failed").alias("failed"), of("dry-run").alias("dry"))


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)
