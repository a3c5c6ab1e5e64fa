"""Files that hold one JSON array each, read by as many tasks as a file has splits.

The text reader cuts a file at every closing brace, so a piece of text never begins inside an
escape, and a task can start anywhere. What a piece does to a parser depends on one bit only, whether
it begins inside a string: a table with an entry for either case says how the nesting depth changes, and
the number of its quotes says whether the next piece begins inside a string. The tables of a
split's pieces are added up to a table of the split, those of the splits before it give the state
it begins with, and so every piece knows its state without any task having read the file from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BRACE = "}"
NOT_AN_ARRAY = "file is not one JSON array: "


def _n(text: Column, letters: str) -> Column:
    """How many of ``letters`` there are in a text."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text before each closing brace: file, block (start of the split), row (order in it), piece.

    ``odd`` is 1 for an odd number of quotes. ``outside`` and ``inside`` are the changes of the
    depth, the brace included, if the piece begins outside or inside a string.
    """
    rows = spark.read.text(path, lineSep=BRACE).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("piece"),
    )
    plain = F.regexp_replace("piece", r"\\[\s\S]", "")
    strings = r'"[^"]*(?:"|\z)'
    rows = rows.withColumns(
        {
            "odd": _n(plain, '"') % 2,
            "_outside": F.regexp_replace(plain, strings, ""),
            "_inside": F.regexp_replace(F.regexp_replace(plain, r'\A[^"]*(?:"|\z)', ""), strings, ""),
        }
    )

    def change(text: str, brace: Column) -> Column:
        return _n(F.col(text), "{[") - _n(F.col(text), "]") - brace

    return rows.select(
        "file", "block", "row", "piece", "odd",
        change("_outside", 1 - F.col("odd")).alias("outside"),
        change("_inside", F.col("odd")).alias("inside"),
    )


def _running(pieces: DataFrame) -> DataFrame:
    """Adds the state before and after each piece, for both states its split may begin with.

    ``flips`` is 1 if the state before the piece is not that at the split's start; ``depth_out`` and
    ``depth_in`` are the changes of the depth since then, the piece included.
    """
    split = Window.partitionBy("file", "block").orderBy("row")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    until = split.rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("flips") == 0
    pieces = pieces.withColumn("flips", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    pieces = pieces.withColumns(
        {
            "_out": F.when(same, F.col("outside")).otherwise(F.col("inside")),
            "_in": F.when(same, F.col("inside")).otherwise(F.col("outside")),
        }
    )
    return pieces.withColumns(
        {"depth_out": F.sum("_out").over(until), "depth_in": F.sum("_in").over(until)}
    )


def _starts(running: DataFrame) -> DataFrame:
    """State at the start of each split: file, block, begins_in (a string), depth.

    One row per split. A file that does not end as an array does fails here.
    """
    splits = running.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("odd"),
        F.max_by("depth_out", "row").alias("out"),
        F.max_by("depth_in", "row").alias("in"),
    )
    file = Window.partitionBy("file").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    splits = splits.withColumn("begins_in", F.coalesce(F.sum("odd").over(before), zero) % 2)
    change = F.when(F.col("begins_in") == 0, F.col("out")).otherwise(F.col("in"))
    splits = splits.withColumn("change", change)
    splits = splits.withColumn("depth", F.coalesce(F.sum("change").over(before), zero))
    # The text after the last brace counts as if a brace came after it.
    last = F.lead("block").over(file).isNull()
    closed = (F.col("depth") + F.col("change") == -1) & ((F.col("begins_in") + F.col("odd")) % 2 == 0)
    failed = F.raise_error(F.concat(F.lit(NOT_AN_ARRAY), F.col("file")))
    depth = F.when(last & ~closed, failed.cast("long")).otherwise(F.col("depth"))
    return splits.select("file", "block", "begins_in", depth.alias("depth"))


def _placed(running: DataFrame) -> DataFrame:
    """Pieces with ``begins`` and ``ends``: whether an element of the array begins or ends with them.

    ``first`` is true for the piece that the array itself begins with.
    """
    known = running.join(_starts(running), ["file", "block"])
    outside = F.col("begins_in") == 0
    after = F.col("depth") + F.when(outside, F.col("depth_out")).otherwise(F.col("depth_in"))
    change = F.when(outside, F.col("_out")).otherwise(F.col("_in"))
    text_before = (F.col("begins_in") + F.col("flips")) % 2
    text_after = (text_before + F.col("odd")) % 2
    begins = (text_before == 0) & (after - change <= 1)
    ends = (text_after == 0) & (after == 1)
    first = (text_before == 0) & (after - change == 0)
    return known.select(
        "file", "block", "row", "piece", begins.alias("begins"), ends.alias("ends"), first.alias("first")
    )


def _joined(parts: DataFrame) -> DataFrame:
    """Elements that are several pieces, such as objects with objects inside: file, text, whole, first.

    Elements are numbered by their beginnings, in a split and then over the splits of the file.
    """
    split = Window.partitionBy("file", "block").orderBy("row")
    parts = parts.withColumn("_n", F.sum(F.col("begins").cast("long")).over(split))
    counts = parts.groupBy("file", "block").agg(F.max("_n").alias("_most"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "file", "block", F.coalesce(F.sum("_most").over(before), F.lit(0)).alias("_base")
    )
    numbered = parts.join(counts, ["file", "block"]).withColumn("_n", F.col("_base") + F.col("_n"))
    whole = numbered.groupBy("file", "_n").agg(
        F.array_sort(F.collect_list(F.struct("block", "row", "piece"))).alias("_pieces"),
        F.bool_or("ends").alias("whole"),
        F.bool_or("first").alias("first"),
    )
    text = F.array_join(F.transform("_pieces", lambda p: p["piece"]), BRACE)
    return whole.select("file", text.alias("text"), "whole", "first")


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Elements of the arrays in all files below ``path``, as JSON text in the column ``value``.

    Every file is one array, of any size, on one line or many. Splits of a file are read by different
    tasks. An element with no object inside and no brace in its texts is one piece, and goes
    no further; the pieces of others are put together by a shuffle. A file that is not one whole array
    fails, also one that ends too early. An empty array has no elements, an empty folder no rows.
    """
    placed = _placed(_running(_pieces(spark, path)))
    single = F.col("begins") & F.col("ends")
    alone = placed.filter(single).select(
        "file", F.col("piece").alias("text"), F.lit(True).alias("whole"), "first"
    )
    elements = alone.unionByName(_joined(placed.filter(~single)))
    # An element follows the array's bracket or a comma. What is left after the last object are
    # elements that are none, if any, and the last bracket.
    text = F.ltrim("text", F.lit(" \n\r\t"))
    body = F.substring(text, F.lit(2), F.length(text))
    led = F.substring(text, 1, 1) == F.when(F.col("first"), "[").otherwise(",")
    bracket = r"\A\s*\]\s*\z"
    more = led & (F.col("first") | ~body.rlike(bracket))
    failed = F.raise_error(F.concat(F.lit(NOT_AN_ARRAY), F.col("file")))
    listed = (
        F.when(F.col("whole") & led, F.concat(F.lit("["), body, F.lit(f"{BRACE}]")))
        .when(~F.col("whole") & more, F.concat(F.lit("["), body))
        .when(~F.col("whole") & ~F.col("first") & text.rlike(bracket), F.lit("[]"))
        .otherwise(failed)
    )
    items = F.from_json(listed, "array<string>", {"mode": "FAILFAST"})
    return elements.select(F.explode(items).alias("value"))
