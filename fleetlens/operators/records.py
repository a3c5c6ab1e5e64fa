"""Keyed loads, schema checks and quality checks of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetlens.functions import fixed
from fleetlens.functions.columns import is_missing
from fleetlens.operators.ranking import top_per_group

Attributes = Sequence[tuple[str, str]]

# Attribute type letters.
TYPE_LETTERS = {
    T.StringType: "S", T.VarcharType: "S", T.CharType: "S", T.BinaryType: "B",
    T.BooleanType: "BOOL", T.NullType: "NULL", T.ArrayType: "L", T.MapType: "M",
    T.StructType: "M",
}
LETTER_TYPES = {
    "S": "string", "N": "double", "B": "binary", "BOOL": "boolean", "NULL": "void",
    "SS": "array<string>", "NS": "array<double>", "L": "array<string>", "M": "map<string,string>",
}


def typed_items(
    sheet: DataFrame,
    key: str = fixed.ITEM_KEY,
    texts: Sequence[str] = fixed.ITEM_TEXTS,
) -> DataFrame:
    """Each row as an item whose attributes carry a type tag; the key is written as text."""
    tagged = [F.struct(F.col(key).cast("string").alias("S")).alias(key)]
    tagged += [F.struct(F.col(c).alias("S")).alias(c) for c in texts]
    return sheet.select(F.struct(*tagged).alias("item"))


def keyed_upsert(
    table: DataFrame,
    puts: DataFrame,
    key: str = fixed.ITEM_KEY,
    order: str = "seq",
) -> DataFrame:
    """Table after the puts, in the order of the distinct column ``order``.

    The last put of a key replaces what was there; rows without a put stay. Rows and puts meet
    in one shuffle, and of each key a task sends one row only.
    """
    old = table.withColumns({"_put": F.lit(0), order: F.lit(None).cast(puts.schema[order].dataType)})
    new = puts.select(*table.columns, order).withColumn("_put", F.lit(1))
    latest = [F.desc("_put"), F.desc_nulls_last(order)]
    return top_per_group(old.unionByName(new), [key], latest, 1).select(*table.columns)


def load_outcomes(
    sheet: DataFrame,
    key: str = fixed.ITEM_KEY,
    texts: Sequence[str] = fixed.ITEM_TEXTS,
) -> DataFrame:
    """Adds status, reason and message: a row that cannot be stored does not stop the others."""
    key_text = F.col(key).cast("string")
    reason = F.when(F.coalesce(key_text, F.lit("")) == "", F.lit(f"{key} is missing"))
    for name in texts:
        if isinstance(sheet.schema[name].dataType, T.StringType):
            reason = reason.when(F.col(name).isNull(), F.lit(f"{name} is missing"))
        else:
            reason = reason.when(F.lit(True), F.lit(f"{name} is not text"))
    shown = F.coalesce(key_text, F.lit(""))
    failed = F.concat(F.lit("Error uploading course "), shown, F.lit(": "), F.col("reason"))
    done = F.concat(F.lit("Course "), shown, F.lit(" uploaded successfully"))
    rejected = F.col("reason").isNotNull()
    return sheet.withColumn("reason", reason).withColumns(
        {
            "status": F.when(rejected, F.lit("rejected")).otherwise(F.lit("accepted")),
            "message": F.when(rejected, failed).otherwise(done),
        }
    )


def declared_schema(df: DataFrame) -> DataFrame:
    """(name, type, n) of a table's own columns; ``n`` is null, nothing is scanned."""
    rows = []
    for field in df.schema.fields:
        kind = field.dataType
        letter = "N" if isinstance(kind, T.NumericType) else TYPE_LETTERS.get(type(kind), "S")
        rows.append((field.name, letter, None))
    return df.sparkSession.createDataFrame(rows, "name string, type string, n bigint")


def filled_schema(df: DataFrame) -> DataFrame:
    """:func:`declared_schema` with ``n``, the number of rows that have a value; one pass over the table."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in df.columns])
    return declared_schema(df).drop("n").join(counts.select(F.inline(each)), "name")


def scanned_schema(items: DataFrame, text: str) -> DataFrame:
    """(name, type, n) of the attributes found in a column of JSON objects.

    For items without a declared schema: every object is read, and counted per attribute and
    type before anything is shuffled. Items that are no object (malformed, null, an array, a
    number) are counted in a row of their own, with a null name and the type ``rejected``.
    """
    kind = F.split_part(F.schema_of_variant(F.col("value")), F.lit("<"), F.lit(1))
    kind = F.split_part(kind, F.lit("("), F.lit(1))
    letter = (
        F.when(kind == "STRING", "S")
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "N")
        .when(kind == "BOOLEAN", "BOOL")
        .when(kind == "VOID", "NULL")
        .when(kind == "ARRAY", "L")
        .when(kind == "OBJECT", "M")
    )
    parsed = items.select(F.try_parse_json(text).alias("_item"))
    is_object = F.coalesce(F.schema_of_variant(F.col("_item")).startswith("OBJECT"), F.lit(False))
    parsed = parsed.select(F.when(is_object, F.col("_item")).alias("_item"))
    attributes = parsed.lateralJoin(
        items.sparkSession.tvf.variant_explode_outer(F.col("_item").outer())
    )
    rejected = F.col("_item").isNull()
    # An empty object has no attribute, and is not rejected either.
    attributes = attributes.filter(F.col("key").isNotNull() | rejected)
    letter = F.when(rejected, "rejected").otherwise(letter)
    return (
        attributes.select(F.col("key").alias("name"), letter.alias("type"))
        .groupBy("name", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def schema_diff(expected: Attributes, actual: DataFrame) -> DataFrame:
    """Expected (name, type) pairs that the actual schema lacks, and why.

    ``missing`` has no attribute of that name, ``type_mismatch`` has one of another type
    (``actual_type``: the types in order, with commas). Attributes only in the actual schema
    are of no interest. The expected list is written in the program and small, so it goes to
    the attributes rather than the other way round.
    """
    schema = "name string, type string"
    wanted = F.broadcast(actual.sparkSession.createDataFrame(list(expected), schema))
    found = actual.join(wanted.select("name").distinct(), "name", "left_semi")
    kinds = found.groupBy("name").agg(F.array_sort(F.collect_set("type")).alias("kinds"))
    return (
        wanted.join(kinds, "name", "left")
        .filter(~F.coalesce(F.array_contains("kinds", F.col("type")), F.lit(False)))
        .select(
            "name",
            F.col("type").alias("expected_type"),
            F.array_join("kinds", ",").alias("actual_type"),
            F.when(F.col("kinds").isNull(), F.lit("missing"))
            .otherwise(F.lit("type_mismatch"))
            .alias("status"),
        )
    )


def schema_gate(differences: DataFrame) -> DataFrame:
    """One row: does the schema have to change?"""
    return differences.agg((F.count(F.lit(1)) > 0).alias("changed"))


def schema_evolve(df: DataFrame, expected: Attributes) -> DataFrame:
    """Adds each expected attribute the table lacks as an empty column of its type.

    A name that exists stays as it is, also with another type.
    """
    missing = {n: F.lit(None).cast(LETTER_TYPES[t]) for n, t in expected if n not in df.columns}
    return df.withColumns(missing) if missing else df


def _missing(df: DataFrame, column: str) -> Column:
    return is_missing(df.schema[column])


def quality_gate(df: DataFrame, required: Sequence[str] = ("name",)) -> DataFrame:
    """Per required column: does any row lack a value, and how many do."""
    counts = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in required])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in required])
    return counts.select(F.inline(rows)).select(
        "column", (F.col("n_missing") > 0).alias("has_issue"), "n_missing"
    )


def lacks_value(df: DataFrame, required: Sequence[str] = ("name",)) -> DataFrame:
    """Per required column: does any row lack a value. Reading ends at the first one that does.

    One part is read first, then four times as many at a time, so a table with an early fault is
    hardly read. ``quality_gate`` also counts them, for which it reads everything.
    """
    found = [(c, bool(df.filter(_missing(df, c)).select(F.lit(1)).head(1))) for c in required]
    return df.sparkSession.createDataFrame(found, "column string, has_issue boolean")


def _any_missing(df: DataFrame, required: Sequence[str]) -> Column:
    bad = F.lit(False)
    for column in required:
        bad = bad | _missing(df, column)
    return bad


def quality_quarantine(df: DataFrame, required: Sequence[str] = ("name",)) -> DataFrame:
    """Rows that lack a required value, with a message that shows the row."""
    lacking = F.array_compact(F.array(*[F.when(_missing(df, c), F.lit(c)) for c in required]))
    shown = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    message = F.concat(
        F.lit("Item with missing "), F.array_join(lacking, ", "), F.lit(": "), shown
    )
    return df.filter(_any_missing(df, required)).withColumn("message", message)


def quality_passed(df: DataFrame, required: Sequence[str] = ("name",)) -> DataFrame:
    """Rows that have every required value."""
    return df.filter(~_any_missing(df, required))
