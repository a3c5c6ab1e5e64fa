"""Session settings and the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "fleetlens", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the jobs expect; ``settings`` use ``_`` for ``.``.

    Wall-clock columns are ``timestamp_ntz``; the time zone is pinned to UTC so that functions
    which go through ``timestamp`` (``date_trunc``, ``timestamp_diff``) see no daylight saving.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The health check generates more code stages than the default cache of 100 holds.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, it lies below the warehouse, which executors share too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str = "step") -> DataFrame:
    """The rows of ``df``, computed now and kept as a table in the shared folder.

    For results that are used several times or whose size is to be measured. They survive the
    loss of executors; later jobs do not compute them again, read only the columns they need
    and know their size.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
