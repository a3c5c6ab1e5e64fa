"""Joins that a plain join cannot say well.

Lookups are joined plainly: Spark broadcasts one whose bytes it knows to be few, from the plan
(a list made by the program) or at run time, and else splits partitions that are too large.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

COPIES_AT_ONCE = 1_000


def repeated(rows: DataFrame) -> DataFrame:
    """Distinct rows with the number of times each occurs, ``_n``."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))


def copied(rows: DataFrame, *counts: str) -> DataFrame:
    """Each row as often as the product of its ``counts`` says."""
    n = F.lit(1).cast("long")
    for c in counts:
        n = n * F.col(c)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).drop(
        "_copy", *counts
    )


def all_pairs(left: DataFrame, right: DataFrame, parts: int | None = None) -> DataFrame:
    """Every left row with every right row, for results that are a product by definition.

    Both sides are cut into about the square root of ``parts`` (default: four per shuffle
    partition) by row hash, and each pair of cuts is one join key. No task holds a whole side,
    unlike a cartesian or a nested-loop join. Equal rows are counted before and dealt out in
    lots of ``COPIES_AT_ONCE``, so a row that is repeated very often spreads as well. Where one side
    is small and broadcast, the other comes in ``parts`` parts by its columns.
    """
    if parts is None:
        parts = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, math.isqrt(parts))

    def lots(df: DataFrame, own: str, other: str) -> DataFrame:
        n = F.col("_n")
        lot = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES_AT_ONCE)))
        rows = repeated(df).withColumn("_lot", lot)
        size = F.least(F.lit(COPIES_AT_ONCE).cast("long"), n - F.col("_lot") * COPIES_AT_ONCE)
        hashed = F.pmod(F.xxhash64(*df.columns, "_lot"), F.lit(side)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
        # A number of partitions that is given stays: Spark would see few rows and make one task of them.
        rows = rows.repartition(parts, *df.columns)
        rows = rows.withColumns({own: hashed, f"_n{own}": size}).withColumn(other, each)
        return rows.drop("_n", "_lot")

    pairs = lots(left, "_l", "_r").join(lots(right, "_r", "_l"), ["_l", "_r"])
    return copied(pairs, "_n_l", "_n_r").drop("_l", "_r")
