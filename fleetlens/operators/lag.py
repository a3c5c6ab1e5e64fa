"""Processing lag by action."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions import fixed


def lag_by_action(
    performance_value: DataFrame,
    actions: Sequence[str] = fixed.LAG_ACTIONS,
    pattern: str = fixed.LAG_PATTERN,
    renamed: Mapping[str, str] = fixed.LAG_RENAMED,
    dropped: str = fixed.LAG_DROPPED_TEXT,
) -> DataFrame:
    """Rows of the lag actions (listed, or like the pattern) with their labels."""
    action = F.col("action")
    label = F.replace(action, F.lit(dropped), F.lit(""))
    for name, shown in renamed.items():
        label = F.when(action == name, F.lit(shown)).otherwise(label)
    return performance_value.filter(action.isin(list(actions)) | action.like(pattern)).select(
        "ts", "database", label.alias("action"), "average_value"
    )


def lag_of_biggest_database(
    performance_value: DataFrame, biggest: DataFrame, **lag: object
) -> DataFrame:
    """Lag rows of each server's biggest database (server, database in lower case).

    ``lag``: arguments of :func:`lag_by_action`.
    """
    rows = lag_by_action(performance_value, **lag).withColumn("database", F.lower("database"))
    chosen = biggest.select("server", "database")
    return rows.join(chosen, "database").select("server", "database", "ts", "action", "average_value")
