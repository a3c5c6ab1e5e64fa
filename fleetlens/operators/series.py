"""Long series to wide tables, and the height of version markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions import fixed


def series_pivot(
    points: DataFrame,
    index: str,
    series: str,
    value: str,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per index value, one column per series, sums in the cells.

    Rows without index or series are dropped. A cell without rows is null; one whose values
    are all null is 0. Without ``names`` Spark looks up the distinct series (and refuses more
    than ``spark.sql.pivotMaxValues``).
    """
    kept = points.filter(F.col(index).isNotNull() & F.col(series).isNotNull())
    pivoted = kept.groupBy(index).pivot(series, list(names) if names else None)
    return pivoted.agg(F.sum(F.coalesce(F.col(value), F.lit(0))).cast("double"))


def marker_bounds(points: DataFrame) -> DataFrame:
    """Ends of the version marker per (machine, panel_no): lo, hi.

    Usually the least and greatest of the series' maxima. The CPU marker runs from 0 to 100,
    the memory marker from 0 to the most allocated memory, the bad-file marker from 0.
    """
    tops = points.groupBy("machine", "panel_no", "series").agg(F.max("y").alias("top"))
    allocated = F.when(F.col("series") == fixed.MEMORY_SERIES["allocated"], F.col("top"))
    ends = tops.groupBy("machine", "panel_no").agg(
        F.min("top").alias("lo"), F.max("top").alias("hi"), F.max(allocated).alias("allocated")
    )
    panel = F.col("panel_no")
    return ends.select(
        "machine",
        "panel_no",
        F.when(panel.isin(1, 2, 11), F.lit(0.0)).otherwise(F.col("lo")).alias("lo"),
        F.when(panel == 1, F.lit(100.0))
        .when(panel == 2, F.col("allocated"))
        .otherwise(F.col("hi"))
        .alias("hi"),
    )
