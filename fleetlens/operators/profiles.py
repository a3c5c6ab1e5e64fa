"""Query statistics by hour and query text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions import fixed
from fleetlens.functions.columns import none_like, ratio, truncate
from fleetlens.operators.ranking import top_per_group


def query_totals(
    statistics: DataFrame,
    excluded: Sequence[str] = fixed.EXCLUDED_QUERY_PATTERNS,
    users: str = fixed.QUERY_USER_PATTERN,
    key_length: int = fixed.QUERY_KEY_LENGTH,
) -> DataFrame:
    """Time and calls per (machine, hour, query key), the key being a query's first characters.

    The null tests repeat what the patterns imply. They spell out the filters that the later
    join would add to one of its sides, so both sides stay equal and share one shuffle.
    """
    text = F.lower("query")
    key = F.substring(text, 1, key_length)
    machine = F.lower("machine")
    return (
        statistics.filter(
            F.col("user_name").like(users) & none_like(text, excluded)
        )
        .filter(machine.isNotNull() & key.isNotNull())
        .groupBy(
            machine.alias("machine"), truncate(F.col("ts"), "hour").alias("hour"), key.alias("key")
        )
        .agg(F.sum("time_ms").alias("time_ms"), F.sum("calls").alias("calls"))
    )


def _top_keys(totals: DataFrame, k: int) -> DataFrame:
    """Keys of the k slowest (hour, key) rows of each machine, and how often each occurs."""
    order = [F.desc_nulls_last("time_ms"), F.asc("key"), F.asc("hour")]
    top = top_per_group(totals.filter(F.col("calls") > 1), ["machine"], order, k)
    return top.groupBy("machine", "key").agg(F.count(F.lit(1)).cast("int").alias("copies"))


def _labelled(rows: DataFrame, label_length: int) -> DataFrame:
    time_ms = F.col("time_ms").cast("double")
    return rows.select(
        "machine",
        "hour",
        F.substring("key", 1, label_length).alias("short_query"),
        time_ms.alias("total_time_ms"),
        F.col("calls").alias("total_calls"),
        ratio(time_ms / 1000, F.col("calls")).alias("sec_per_call"),
    )


def query_profile(
    statistics: DataFrame,
    k: int = fixed.TOP_QUERIES,
    label_length: int = fixed.QUERY_LABEL_LENGTH,
    **totals: object,
) -> DataFrame:
    """All hours of the top query keys, a row once for every top row that has its key.

    The top list is one row per (hour, key), so a key that is slow in many hours repeats the
    key's rows. It is counted before the join and the rows are repeated after it. The top keys
    come from the same totals, so an outer join would add nothing. ``totals``: arguments of
    :func:`query_totals`.
    """
    rows = query_totals(statistics, **totals)
    joined = rows.join(_top_keys(rows, k), ["machine", "key"])
    repeated = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _labelled(repeated, label_length)


def query_profile_dedup(
    statistics: DataFrame,
    k: int = fixed.TOP_QUERIES,
    label_length: int = fixed.QUERY_LABEL_LENGTH,
    **totals: object,
) -> DataFrame:
    """All hours of the top query keys, each row once.

    The keys are distinct, so an inner join is the semi-join; unlike that it is never moved
    below the totals, which would read the statistics twice.
    """
    rows = query_totals(statistics, **totals)
    return _labelled(rows.join(_top_keys(rows, k), ["machine", "key"]), label_length)
