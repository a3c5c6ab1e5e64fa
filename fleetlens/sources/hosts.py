"""Host lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions.columns import strip


def read_hosts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One host per line, without white space at the ends; an empty line is an empty host."""
    return spark.read.text(path).select(strip(F.col("value")).alias(column))
