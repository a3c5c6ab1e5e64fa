"""Connectivity probes between hosts: what to probe, and what the outputs mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions import fixed
from fleetlens.functions.columns import strip
from fleetlens.operators.joins import all_pairs


def probe_matrix(
    sources: DataFrame, destinations: DataFrame, ports: str, parts: int | None = None
) -> DataFrame:
    """Every (src, dst, port) with the place of the port in the list.

    ``sources`` has a column src, ``destinations`` a column dst, ``ports`` is a text with any
    white space between the ports. The result is a product by definition, made in ``parts`` parts.
    """
    listed = F.split(strip(F.lit(ports)), r"\s+")
    pairs = all_pairs(sources.select("src"), destinations.select("dst"), parts)
    return pairs.select("src", "dst", F.posexplode(listed).alias("port_order", "port"))


def output_status(output: Column) -> Column:
    """Status of a probe from its output text."""
    text = strip(output)
    lines = F.split(text, "\n")
    last = F.when(F.size(lines) > 1, strip(F.element_at(lines, -1)))
    return (
        F.when(text.contains(fixed.REFUSED_TEXT), F.lit(fixed.REFUSED_STATUS))
        .when(text.contains(fixed.UNRESOLVED_TEXT), F.lit(fixed.UNRESOLVED_STATUS))
        .otherwise(F.coalesce(last, F.lit(fixed.UNKNOWN_STATUS)))
    )


def probe_status(outputs: DataFrame) -> DataFrame:
    """Status rows from probe outputs (src, dst, port_order, port, output, error).

    A connection error (``name`` or ``auth``) ends its (src, dst) pair: it gives one row with
    port N/A, and later ports of the pair give none. A pair has no more rows than there are
    ports, so the window stays small.
    """
    earlier = Window.partitionBy("src", "dst").orderBy("port_order")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("error").isNotNull()
    errors_before = F.coalesce(F.sum(failed.cast("int")).over(earlier), F.lit(0))
    kept = outputs.withColumn("_before", errors_before).filter(F.col("_before") == 0)
    status = (
        F.when(F.col("error") == "name", F.concat("port", F.lit(" is not reachable")))
        .when(F.col("error") == "auth", F.lit(fixed.AUTHENTICATION_STATUS))
        .when(failed, F.col("error"))
        .otherwise(output_status(F.col("output")))
    )
    return kept.select(
        "src",
        "dst",
        "port_order",
        F.when(failed, F.lit("N/A")).otherwise(F.col("port")).alias("port"),
        status.alias("status"),
    )


def probe_report(statuses: DataFrame) -> DataFrame:
    """Each status row as fields between ``#`` (line) and as a sentence."""
    sentence = F.format_string(
        "Source host %s Dest host %s Port %s - %s",
        F.col("src"), F.col("dst"), F.col("port"), F.col("status"),
    )
    line = F.concat_ws("#", "src", "dst", "port", "status")
    return statuses.select(
        "src", "dst", "port_order", line.alias("line"), sentence.alias("sentence")
    )
