"""Seconds and API calls by machine, through the names under which machines report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions import fixed
from fleetlens.functions.columns import entry_name, not_negative, truncate
from fleetlens.operators.ranking import top_per_group


def active_name_map(
    performance_time_today: DataFrame,
    alias: str = fixed.ALIAS_PATTERN,
    prefix: str = fixed.PRODUCTION_PREFIX,
) -> DataFrame:
    """Names reporting in the newest shard and the machine each stands for."""
    names = performance_time_today.select("machine").distinct()
    return names.withColumn("entry", entry_name(F.col("machine"), alias, prefix))


def _keys(names: DataFrame) -> DataFrame:
    """Lower-case name that reports, and the lower-case machine it stands for."""
    keys = names.select(F.lower("machine").alias("reported"), F.lower("entry").alias("machine"))
    return keys.filter(F.col("reported").isNotNull() & F.col("machine").isNotNull()).distinct()


def performance_seconds(performance_time: DataFrame, names: DataFrame) -> DataFrame:
    """CPU and elapsed seconds per (machine, ts, source); negative sums become 0.

    Rows without an action do not count. Facts are summed per reporting name before the names
    are joined, so a name with very many rows shrinks where it is read.
    """
    acting = performance_time.filter(F.col("action").isNotNull() & (F.col("action") != ""))
    sums = [F.sum(c).alias(c) for c in ("cpu_seconds", "seconds")]
    reported = acting.groupBy(F.lower("machine").alias("reported"), "ts", "source").agg(*sums)
    return (
        reported.join(_keys(names), "reported")
        .groupBy("machine", "ts", "source")
        .agg(
            not_negative(F.sum("cpu_seconds").cast("double")).alias("cpu_seconds"),
            not_negative(F.sum("seconds").cast("double")).alias("actual_seconds"),
        )
    )


def api_usage_top_calls(
    api_usage: DataFrame,
    names: DataFrame,
    k: int = fixed.TOP_CALLS,
    excluded: Sequence[str] = fixed.EXCLUDED_CALLS,
) -> DataFrame:
    """Size, seconds and calls per (machine, minute, call) for each machine's ``k`` top calls.

    Calls are summed per reporting name before the names are joined. One aggregate per minute
    serves the ranking and the result. The ranking orders by the sums it carries as well
    (after the unique name, so without effect), hence both uses read the same columns and
    Spark runs that aggregate's shuffle once.
    """
    kept = api_usage.filter(F.col("call").isNotNull() & ~F.col("call").isin(list(excluded)))
    minute = truncate(F.col("ts"), "minute").alias("minute")
    sums = [F.sum("size_kb").alias("size_kb"), F.sum("seconds").alias("seconds")]
    reported = kept.groupBy(F.lower("machine").alias("reported"), minute, "call").agg(
        *sums, F.count(F.lit(1)).alias("calls")
    )
    sums = [*sums, F.sum("calls").alias("calls")]
    by_minute = reported.join(_keys(names), "reported").groupBy("machine", "minute", "call").agg(*sums)
    by_call = by_minute.groupBy("machine", "call").agg(*sums)
    order = [F.desc("calls"), F.asc("call"), F.asc("size_kb"), F.asc("seconds")]
    top = top_per_group(by_call, ["machine"], order, k).select("machine", "call")
    # The pairs are distinct, so it is a semi-join that cannot be moved below the aggregate.
    return by_minute.join(top, ["machine", "call"]).select(
        "machine",
        "minute",
        "call",
        F.col("size_kb").cast("double").alias("total_size"),
        F.col("seconds").cast("double").alias("total_secs"),
        "calls",
    )
