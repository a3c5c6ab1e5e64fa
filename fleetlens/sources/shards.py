"""Tables kept as one shard per day."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens.functions import fixed

DAY = "dt"
UNITS = {"DAY": "days", "HOUR": "hours", "MINUTE": "minutes", "SECOND": "seconds"}


def day_key(when: datetime) -> str:
    return when.strftime("%Y%m%d")


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table written by :func:`write_shards`; the day stays text instead of becoming a number."""
    fields = [f for f in schema.fields if f.name != DAY]
    return spark.read.schema(T.StructType([*fields, T.StructField(DAY, T.StringType())])).parquet(path)


def write_shards(df: DataFrame, path: str) -> None:
    """Write one folder per day; a day's rows are spread over files of even size."""
    df.hint("rebalance", DAY).write.partitionBy(DAY).parquet(path)


def _days(df: DataFrame, first: datetime, last: datetime, ts: str) -> DataFrame:
    if DAY in df.columns:
        return df.filter(F.col(DAY).between(day_key(first), day_key(last)))
    begin = _literal(datetime(first.year, first.month, first.day))
    end = _literal(datetime(last.year, last.month, last.day) + timedelta(days=1))
    return df.filter((F.col(ts) >= begin) & (F.col(ts) < end))


def trailing_shards(
    df: DataFrame,
    as_of: datetime,
    value: int = 14,
    unit: str = "DAY",
    ts: str = "ts",
) -> DataFrame:
    """Shards from ``value`` units before ``as_of`` up to its day, both ends included.

    The bounds are literals. A table with the day column skips whole folders; any other is cut
    to the same days by its time column ``ts``, which reaches the file scan and skips row groups.
    """
    return _days(df, as_of - timedelta(**{UNITS[unit.upper()]: value}), as_of, ts)


def single_shard(df: DataFrame, as_of: datetime, ts: str = "ts") -> DataFrame:
    """The shard of one day."""
    return _days(df, as_of, as_of, ts)


def _literal(when: datetime) -> Column:
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def warehouse_table(df: DataFrame, table: str) -> DataFrame:
    """Columns of a warehouse table under the names the jobs use, the day column included."""
    names = fixed.TABLE_COLUMNS[table]
    columns = [F.col(old).alias(new) for old, new in names.items()]
    return df.select(*columns, *([DAY] if DAY in df.columns else []))
