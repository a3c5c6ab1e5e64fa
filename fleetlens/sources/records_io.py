"""JSON records in, CSV out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens.functions import fixed
from fleetlens.sources.json_arrays import read_json_arrays

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _strict_fields(record: Column, columns: Sequence[str]) -> list[Column]:
    """The named fields of a JSON object as text; any other key, or no object, is an error."""
    keys = F.json_object_keys(record)
    extra = F.array_except(keys, F.array(*[F.lit(c) for c in columns]))
    found = F.concat(F.lit("record has fields not in the list: "), F.array_join(extra, ", "))
    checked = (
        F.when(keys.isNull(), F.raise_error(F.lit("record is not a JSON object")))
        .when(F.size(extra) > 0, F.raise_error(found))
        .otherwise(record)
    )
    return [F.coalesce(F.get_json_object(checked, f"$['{c}']"), F.lit("")).alias(c) for c in columns]


def read_records(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = fixed.RECORD_COLUMNS,
    array_per_file: bool = False,
) -> DataFrame:
    """Records as text columns in the declared order; missing keys are empty, others an error.

    With ``array_per_file`` every file is one JSON array, else lines of objects (the default). Either
    form is read by as many tasks as a file has splits. Booleans, numbers and lists become their
    JSON text.
    """
    if array_per_file:
        lines = read_json_arrays(spark, path)
    else:
        lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(*_strict_fields(F.col("value"), columns))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes are doubled, empty text stays empty."""
    df.write.options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] = fixed.RECORD_COLUMNS) -> DataFrame:
    """CSV written by :func:`write_csv`, with empty text for empty fields."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.options(**CSV_OPTIONS, multiLine="true", enforceSchema="false").schema(schema).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def records_to_csv(
    spark: SparkSession,
    source: str,
    target: str,
    columns: Sequence[str] = fixed.RECORD_COLUMNS,
    array_per_file: bool = False,
) -> DataFrame:
    """Convert JSON records to CSV and return what the CSV holds."""
    write_csv(read_records(spark, source, columns, array_per_file), target)
    return read_csv(spark, target, columns)
