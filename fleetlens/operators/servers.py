"""Versions, databases and release stages of servers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions import fixed
from fleetlens.operators.ranking import top_per_group


def first_seen_versions(server_info: DataFrame) -> DataFrame:
    """First time each version was reported by each server."""
    return server_info.groupBy("server", "version").agg(F.min("ts").alias("first_seen"))


def latest_version_marker(
    servers: DataFrame, first_seen: DataFrame, unknown: str = fixed.UNKNOWN_VERSION
) -> DataFrame:
    """Per listed server the version that appeared last; a default where none is known.

    Versions that appeared at the same time are ordered by name.
    """
    order = [F.desc_nulls_last("first_seen"), F.asc("version")]
    newest = top_per_group(first_seen, ["server"], order, 1)
    return (
        servers.select("server")
        .distinct()
        .join(newest.withColumn("_known", F.lit(True)), "server", "left")
        .select(
            "server",
            F.when(F.col("_known"), F.col("version"))
            .otherwise(unknown)
            .alias("version"),
            F.col("first_seen").alias("last_upgrade"),
        )
    )


def bad_file_count(database_info: DataFrame) -> DataFrame:
    """Bad files of all databases per (ts, server)."""
    return database_info.groupBy("server", "ts").agg(F.sum("bad_files").alias("total_bad_files"))


def biggest_database(database_info_today: DataFrame) -> DataFrame:
    """Per server the database with most devices in its newest status, in lower case.

    Of several rows with the newest time the one with most devices can win, so the greatest
    (time, devices) pair of a database is all that is needed. Equal databases go by name.
    """
    newest = (
        database_info_today.filter(F.col("server").isNotNull())
        .groupBy("server", "name")
        .agg(F.max(F.struct("ts", "devices")).alias("status"))
    )
    named = newest.select("server", F.lower("name").alias("database"), "status.devices")
    order = [F.desc_nulls_last("devices"), F.asc("database")]
    return top_per_group(named, ["server"], order, 1)


def stage_one_servers(
    instances_today: DataFrame,
    major: str,
    project: str = fixed.STAGE_PROJECT_PATTERN,
    metadata: str = fixed.STAGE_METADATA_PATTERN,
    prefix: str = fixed.PRODUCTION_PREFIX,
) -> DataFrame:
    """Machines whose metadata text names the release stage of a major version."""
    wanted = metadata.format(major=major)
    host = F.split_part("name", F.lit("-"), F.lit(1))
    number = F.substring(host, 3, 2**31 - 1)
    return instances_today.filter(
        F.lower("project").like(project) & F.lower("metadata").like(wanted)
    ).select(F.concat(F.lit(prefix), number).alias("machine"))
