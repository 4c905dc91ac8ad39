"""What a session needs before Python code of this package can run on executors."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Rows of an Arrow batch that Python code gets. Whole texts are long, and both sides of the pipe hold a batch at once.
ARROW_ROWS, SPARKS_OWN = "2000", "10000"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, as ``--py-files`` would.

    Arrow batches are made smaller too, unless the session has set their size itself.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, SPARKS_OWN) == SPARKS_OWN:
        spark.conf.set(rows, ARROW_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew if its files give fewer splits than there are cores, so that a table in one file keeps them all busy.

    Large tables have more splits than that and stay as they are; a table of one split (below ``spark.sql.files.openCostInBytes``) is not worth it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 < df.rdd.getNumPartitions() < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint in ``spark.checkpoint.dir``; where that is missing, a temporary folder stands in for a master within this process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkwell-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that setting is missing, a master within this process gets a temporary folder; any other is refused, since
    its executors could not read what the driver or each other wrote. What is left in this application's part of the folder
    goes when its JVM ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkwell-"))
    mine = context._jsc.sc().getCheckpointDir().get()
    if mine not in _leaving:
        _leaving.add(mine)
        path = context._jvm.org.apache.hadoop.fs.Path(mine)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return mine.rstrip("/")


_leaving: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: no lineage, compressed.

    The table stays until the application ends, as what is made of it may be computed at any time; ``erase`` takes it away before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
