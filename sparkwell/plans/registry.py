"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = f(lambda name: spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")))
            # One width of integers, as the second engine counts.
            return df.select([F.col(f"`{c}`").cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, kind in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
