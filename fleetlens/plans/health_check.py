"""The health check: every panel of every machine as one long table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions import fixed
from fleetlens.functions.columns import host_name
from fleetlens.operators.counters import (
    cpu_buckets,
    counter_sums,
    memory_usage,
)
from fleetlens.operators.lag import lag_of_biggest_database
from fleetlens.operators.profiles import query_profile
from fleetlens.operators.series import marker_bounds
from fleetlens.operators.servers import (
    bad_file_count,
    biggest_database,
    first_seen_versions,
    latest_version_marker,
)
from fleetlens.operators.usage import active_name_map, api_usage_top_calls, performance_seconds
from fleetlens.sources.shards import single_shard, trailing_shards

POINT = ("machine", "panel_no", "panel", "kind", "series", "x", "y")


@dataclass(frozen=True)
class Sources:
    """Input tables with the columns of ``fixed.TABLE_COLUMNS``, by day shard if there is ``dt``."""

    performance: DataFrame
    installed_applications: DataFrame
    server_info: DataFrame
    performance_time: DataFrame
    api_usage: DataFrame
    query_statistics: DataFrame
    database_info: DataFrame
    performance_value: DataFrame


def machine_list(
    spark: SparkSession,
    names: Sequence[str],
    forms: Mapping[str, tuple[str, str]] = fixed.HOST_FORMS,
    prefix_length: int = fixed.MACHINE_PREFIX_LENGTH,
) -> DataFrame:
    """Machines to report, with the lower-case key and the host of each."""
    # Written as an expression, the list has a size that Spark knows.
    listed = F.array(*[F.lit(n) for n in dict.fromkeys(names)]).cast("array<string>")
    return with_keys(spark.range(1).select(F.explode(listed).alias("machine")), forms, prefix_length)


def with_keys(
    machines: DataFrame,
    forms: Mapping[str, tuple[str, str]] = fixed.HOST_FORMS,
    prefix_length: int = fixed.MACHINE_PREFIX_LENGTH,
) -> DataFrame:
    """Adds key and host to a column ``machine``, e.g. of ``stage_one_servers``."""
    name = F.col("machine")
    host = host_name(name, forms, prefix_length).alias("host")
    return machines.select(name, F.lower(name).alias("key"), host)


def _points(
    rows: DataFrame, x: str, panels: Sequence[tuple[int, Column, Column]], *kept: str
) -> DataFrame:
    """One row per panel and series from one row with several measures: a single pass."""
    each = F.array(
        *[
            F.struct(
                F.lit(n).alias("panel_no"),
                s.alias("series"),
                F.col(x).alias("x"),
                y.cast("double").alias("y"),
            )
            for n, s, y in panels
        ]
    )
    return rows.select("machine", *kept, F.inline(each))


def _fixed_series(panel: int, names: Mapping[str, str]) -> list[tuple[int, Column, Column]]:
    return [(panel, F.lit(shown), F.col(c)) for c, shown in names.items()]


def _by_series(series: str, measures: Mapping[int, str]) -> list[tuple[int, Column, Column]]:
    return [(panel, F.col(series), F.col(c)) for panel, c in measures.items()]


def _pivot_cells(points: DataFrame) -> DataFrame:
    """What a pivot would show: no null keys, and 0 for a cell without any value."""
    return points.filter(F.col("x").isNotNull() & F.col("series").isNotNull()).withColumn(
        "y", F.coalesce("y", F.lit(0.0))
    )


def _titled(points: DataFrame) -> DataFrame:
    """Adds the panel title; the lag panel names the database it shows."""
    titles = F.create_map(*[F.lit(v) for pair in fixed.PANELS.items() for v in pair])
    title = titles[F.col("panel_no")]
    lag = F.concat(title, F.coalesce("database", F.lit("")))
    return points.withColumn("panel", F.when(F.col("panel_no") == 12, lag).otherwise(title))


def health_check_panels(
    sources: Sources,
    machines: DataFrame,
    as_of: datetime,
    *,
    days: int = 14,
    performance_days: int = 7,
) -> DataFrame:
    """All panels of all listed machines: machine, panel_no, panel, kind, series, x, y.

    ``machines`` comes from :func:`machine_list` or :func:`with_keys`. Spark knows the bytes of a
    list that the program made and broadcasts it if they are few, so facts of other machines are
    dropped where they are read; the size of any other list shows when it has been computed.
    Building the plan starts no job.

    A panel without data gives no rows. Every other panel has two marker rows, the lower and
    the upper end of a line at the time of the last version change, named after the version.
    The points feed both the result and the markers; each panel ends in an aggregate whose
    shuffle Spark runs once for the two.
    """
    machines = machines.filter(F.col("machine").isNotNull())
    keys = machines.select("key", "machine")
    hosts = machines.select(F.col("host").alias("server"), "machine")
    hosts = hosts.filter(F.col("server").isNotNull())

    def window(df: DataFrame, value: int = days) -> DataFrame:
        return trailing_shards(df, as_of, value)

    def among(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
        return df.join(listed.select(column), column, "left_semi")

    def by_machine(df: DataFrame, name: str = "machine") -> DataFrame:
        """Rows of listed machines; names are compared in lower case."""
        return among(df.withColumn("key", F.lower(name)), keys, "key").drop("key")

    def named(points: DataFrame) -> DataFrame:
        """Lower-case machine keys replaced by the names in the list."""
        return points.withColumnRenamed("machine", "key").join(keys, "key").drop("key")

    performance = by_machine(window(sources.performance))
    samples = counter_sums(performance, fixed.CPU_COUNTERS)
    cpu = cpu_buckets(samples, performance, window(sources.installed_applications))
    memory = memory_usage(performance)

    today = active_name_map(single_shard(sources.performance_time, as_of))
    entries = by_machine(today, "entry")
    seconds = performance_seconds(window(sources.performance_time, performance_days), entries)
    calls = api_usage_top_calls(window(sources.api_usage), entries)

    queries = by_machine(window(sources.query_statistics))
    queries = query_profile(queries)
    queries = queries.groupBy("machine", "hour", "short_query").agg(
        *[F.sum(c).alias(c) for c in ("total_calls", "sec_per_call", "total_time_ms")]
    )

    bad_files = bad_file_count(among(window(sources.database_info), hosts, "server"))
    bad_files = bad_files.join(hosts, "server")

    databases = among(single_shard(sources.database_info, as_of), hosts, "server")
    biggest = hosts.join(biggest_database(databases), "server").select("machine", "database")
    lag = lag_of_biggest_database(
        window(sources.performance_value),
        biggest.withColumnRenamed("machine", "server"),
    )
    lag = lag.groupBy(F.col("server").alias("machine"), "database", "ts", "action").agg(
        F.sum("average_value").alias("average_value")
    )

    c = F.col
    plain = [
        named(_points(cpu, "bucket", _fixed_series(1, fixed.CPU_SERIES))),
        named(_points(memory, "ts", _fixed_series(2, fixed.MEMORY_SERIES))),
        _points(bad_files, "ts", [(11, F.lit(fixed.BAD_FILES_SERIES), c("total_bad_files"))]),
    ]
    pivoted = [
        named(_points(seconds, "ts", _by_series("source", {3: "cpu_seconds", 4: "actual_seconds"}))),
        named(_points(calls, "minute", _by_series("call", {5: "calls", 6: "total_size", 7: "total_secs"}))),
        named(
            _points(
                queries,
                "hour",
                _by_series("short_query", {8: "total_calls", 9: "sec_per_call", 10: "total_time_ms"}),
            )
        ),
        _points(lag, "ts", _by_series("action", {12: "average_value"}), "database"),
    ]
    parts = [*plain, *[_pivot_cells(p) for p in pivoted]]
    points = parts[0]
    for part in parts[1:]:
        points = points.unionByName(part, allowMissingColumns=True)

    info = among(window(sources.server_info), hosts, "server")
    versions = latest_version_marker(hosts, first_seen_versions(info))
    about = (
        machines.select("machine", c("host").alias("server"))
        .join(versions, "server", "left")
        .join(biggest, "machine", "left")
        .select(
            "machine",
            "database",
            F.coalesce("version", F.lit(fixed.UNKNOWN_VERSION)).alias("series"),
            c("last_upgrade").alias("x"),
        )
    )
    markers = (
        marker_bounds(points)
        .join(about, "machine")
        .select(
            "machine", "panel_no", "series", "x", "database", F.explode(F.array("lo", "hi")).alias("y")
        )
    )
    rows = points.withColumn("kind", F.lit("series"))
    return _titled(rows.unionByName(markers.withColumn("kind", F.lit("marker")))).select(*POINT)


def panel_report_write(
    panels: DataFrame,
    machines: DataFrame,
    path: str,
    as_of: datetime,
    base_url: str,
    *,
    kind: str = "ServerPerformance",
) -> DataFrame:
    """Write the panels to one folder per machine: machine, folder, url and n_rows of every machine.

    ``machines`` has a column machine; a listed machine without rows has a link and 0 rows, and
    an empty folder at most. A link leads to the folder that the machine's rows are in, below
    the name of the report. Rows are gathered by machine in parts of even size, so a machine with
    many rows is written by many tasks and a small one does not leave a file per task.
    """
    report = f"{as_of.strftime('%Y%m%d-%H%M')}-{kind}"
    target = f"{path.rstrip('/')}/{report}"
    panels.hint("rebalance", "machine").write.partitionBy("machine").parquet(target)
    stored = panels.sparkSession.read.schema(panels.schema).parquet(target)
    counts = stored.groupBy("machine").agg(F.count(F.lit(1)).alias("n_rows"))
    folder = F.concat(F.lit(f"{report}/machine="), "machine")
    return (
        machines.select("machine").filter(F.col("machine").isNotNull()).distinct()
        .join(counts, "machine", "left")
        .select(
            "machine",
            folder.alias("folder"),
            F.concat(F.lit(base_url.rstrip("/") + "/"), folder).alias("url"),
            F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"),
        )
    )
