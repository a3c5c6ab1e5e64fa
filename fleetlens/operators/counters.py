"""Time series from tall counter rows (machine, ts, counter, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import fixed
from fleetlens.functions.columns import ratio

CPU_MEASURES = ("checkmate", "maintenance", "nodejs", "total", "postgres")


def _sum_of(counter: str) -> Column:
    """Sum of one counter in a sample; a counter that is absent counts as 0, not null."""
    return F.sum(F.when(F.col("counter") == counter, F.col("value")).otherwise(0))


def counter_sums(performance: DataFrame, counters: Mapping[str, str] = fixed.CPU_COUNTERS) -> DataFrame:
    """One row per (machine, ts) with one column per counter."""
    sums = [_sum_of(counter).alias(name) for name, counter in counters.items()]
    return performance.filter(F.col("machine").isNotNull()).groupBy("machine", "ts").agg(*sums)


def latest_cores(applications: DataFrame) -> DataFrame:
    """Newest row of each (machine in any spelling, core count): machine, cores, ts.

    ``machine`` is the newest row's spelling, of equal times the greater one. Groups are formed
    before the cast: "4" and "4.0" stay two rows.
    """
    newest = F.max(F.struct("ts", "machine")).alias("newest")
    rows = applications.groupBy(F.lower("machine").alias("key"), "cores").agg(newest)
    return rows.select("newest.machine", F.col("cores").cast("double").alias("cores"), "newest.ts")


def _core_rows(cores: DataFrame) -> DataFrame:
    """Distinct (machine, cores) with the number of rows, each of which repeats a sample."""
    return (
        cores.filter(F.col("machine").isNotNull())
        .groupBy("machine", "cores")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def _scaled(samples: DataFrame) -> DataFrame:
    """CPU measures of samples that carry ``cores`` and ``copies``."""
    copies, cores = F.coalesce("copies", F.lit(1)), F.col("cores")

    def total(counter: str) -> Column:
        return F.col(counter).cast("double") * copies

    return samples.select(
        *[c for c in samples.columns if c not in fixed.CPU_COUNTERS],
        (ratio(total("checkmate_windows"), cores) + total("checkmate_linux")).alias("checkmate"),
        total("maintenance").alias("maintenance"),
        ratio(total("nodejs"), cores).alias("nodejs"),
        total("total").alias("total"),
        total("postgres").alias("postgres"),
    )


def counter_pivot(
    performance: DataFrame,
    cores: DataFrame,
    counters: Mapping[str, str] = fixed.CPU_COUNTERS,
) -> DataFrame:
    """CPU measures per (machine, ts, cores).

    Samples are summed before the join, so the join sees one row per sample. A machine with
    several core counts in the range gives each sample once per count, one without any gives
    null in the columns that are divided by it.
    """
    samples = counter_sums(performance, counters)
    return _scaled(samples.join(_core_rows(cores), "machine", "left")).select("machine", "ts", "cores", *CPU_MEASURES)


def _bucket_means(samples: DataFrame, key: str, measures: Sequence[str], minutes: int) -> DataFrame:
    """Means per cell of a grid that starts at ``origin``.

    The grid tiles the time without gaps, so the cell of a sample follows from arithmetic and
    no range join is needed; empty cells do not appear.
    """
    width = F.lit(minutes * 60_000_000)
    offset = F.timestamp_diff("MICROSECOND", F.col("origin"), F.col("ts"))
    start = F.timestamp_add("MICROSECOND", offset - F.pmod(offset, width), F.col("origin"))
    return (
        samples.filter(F.col("ts").isNotNull())
        .groupBy(F.col(key), start.alias("bucket"))
        .agg(*[F.avg(m).alias(m) for m in measures])
    )


def bucket_avg(
    samples: DataFrame,
    measures: Sequence[str],
    key: str = "machine",
    minutes: int = 5,
) -> DataFrame:
    """Means per cell of ``minutes`` minutes, counted from the first sample of each key."""
    samples = samples.filter(F.col(key).isNotNull())
    origin = samples.groupBy(key).agg(F.min("ts").alias("origin"))
    return _bucket_means(samples.join(origin, key), key, measures, minutes)


def cpu_buckets(
    samples: DataFrame, times: DataFrame, applications: DataFrame, minutes: int = 5
) -> DataFrame:
    """CPU measures per machine and bucket; machine names are compared in lower case.

    ``samples`` come from :func:`counter_sums`; ``times`` (machine, ts) are the rows they were made
    of, of which only the first time per machine is needed. Cores belong to one spelling of a
    machine name, the grid to all spellings together.
    """
    key = F.lower("machine").alias("key")
    origin = times.filter(F.col("machine").isNotNull()).groupBy(key)
    origin = origin.agg(F.min("ts").alias("origin"))
    cores = _core_rows(latest_cores(applications))
    placed = samples.withColumn("key", key).join(origin, "key").join(cores, "machine", "left")
    means = _bucket_means(_scaled(placed), "key", CPU_MEASURES, minutes)
    return means.withColumnRenamed("key", "machine")


def cpu_usage_buckets(
    performance: DataFrame,
    applications: DataFrame,
    counters: Mapping[str, str] = fixed.CPU_COUNTERS,
    minutes: int = 5,
) -> DataFrame:
    """:func:`cpu_buckets` of counter rows."""
    return cpu_buckets(counter_sums(performance, counters), performance, applications, minutes)


def memory_counters(counters: Mapping[str, Mapping[str, int]] = fixed.MEMORY_COUNTERS) -> dict[str, str]:
    """Columns that :func:`memory_gb` needs from :func:`counter_sums`."""
    return {f"{name}_{n}": c for name, parts in counters.items() for n, c in enumerate(parts)}


def memory_gb(
    samples: DataFrame, counters: Mapping[str, Mapping[str, int]] = fixed.MEMORY_COUNTERS
) -> DataFrame:
    """Memory in GB per (machine, ts); two counters of unlike unit may feed one column."""
    columns = []
    for name, parts in counters.items():
        total = F.lit(0.0)
        for n, divisor in enumerate(parts.values()):
            total = total + F.col(f"{name}_{n}").cast("double") / F.lit(float(divisor))
        columns.append(total.alias(name))
    return samples.select("machine", "ts", *columns)


def memory_usage(
    performance: DataFrame,
    counters: Mapping[str, Mapping[str, int]] = fixed.MEMORY_COUNTERS,
) -> DataFrame:
    """:func:`memory_gb` of counter rows; machine names are compared in lower case."""
    lower = performance.withColumn("machine", F.lower("machine"))
    return memory_gb(counter_sums(lower, memory_counters(counters)), counters)


def merged_spellings(samples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Samples of all spellings of a machine name added up under the lower-case name."""
    sums = [F.sum(c).alias(c) for c in columns]
    return samples.groupBy(F.lower("machine").alias("machine"), "ts").agg(*sums)
