"""Top rows per group, consecutive numbers and total orders without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.session import written

BLOCK_BITS = 21


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group. ``order`` has to be total for a repeatable result.

    Spark turns the filter on ``row_number`` into a group limit before the shuffle, so a group
    sends at most ``k`` rows per task, however large it is.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def consecutive(df: DataFrame, seq: str, number: str) -> DataFrame:
    """Adds 1, 2, 3, ... in the order of ``seq``, a column of distinct 64-bit integers.

    Rows are numbered inside blocks of ``2**21`` sequence values, blocks inside groups of
    ``2**21`` blocks, and those groups (again at most ``2**21``) once. Since ``seq`` is
    distinct no window holds more than ``2**21`` rows, whatever the data looks like.
    """
    block, group = F.shiftright(seq, BLOCK_BITS), F.shiftright("_block", BLOCK_BITS)
    rows = df.withColumn("_block", block)

    def before(*keys: str):
        window = Window.partitionBy(*keys[:-1]) if len(keys) > 1 else Window.partitionBy(F.lit(0))
        window = window.orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    blocks = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", group)
    groups = blocks.groupBy("_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select("_group", before("_group").alias("_group_start"))
    blocks = blocks.select("_group", "_block", before("_group", "_block").alias("_block_start"))
    starts = blocks.join(groups, "_group").select(
        "_block", (F.col("_group_start") + F.col("_block_start")).alias("_start")
    )
    in_block = F.row_number().over(Window.partitionBy("_block").orderBy(seq))
    return (
        rows.join(starts, "_block")
        .withColumn(number, F.col("_start") + in_block)
        .drop("_block", "_start")
    )


def total_order(df: DataFrame, group: Sequence[str], order: Sequence[Column], number: str) -> DataFrame:
    """Rows with their place 1, 2, 3, ... in the order of several keys within each group.

    Rows are dealt by ranges of (group, order), sorted in their part and kept as a table. A row's
    place is that in its part, plus the rows of its group in the parts before, which takes one row per
    part and group. No task sorts more than a part, also if one group has most of all rows. Ties
    are broken by a hash of the row, so that rows with equal keys spread as well. An empty ``group``
    is one order of all rows.
    """
    hashed = F.xxhash64(*df.columns)
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order, hashed.asc()]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = written(rows.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    counts = kept.groupBy(*group, part.alias("_part")).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"_{c}") for c in group],
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = part == F.col("_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = kept.join(starts, same).withColumn(number, F.col("_id") + F.col("_shift"))
    return found.select(*df.columns, number)


def write_in_order(numbered: DataFrame, group: str, number: str, path: str) -> None:
    """Writes a folder per ``group`` whose files, by name, and their rows are in the order of ``number``."""
    keys = [F.col(group).asc_nulls_first(), F.col(number).asc()]
    rows = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.write.partitionBy(group).parquet(path)
