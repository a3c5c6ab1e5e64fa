"""Column expressions shared by the jobs. All stay inside Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F, types as T

from fleetlens.functions import fixed

WHITE_SPACE = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    """Both ends without white space of any kind (``trim`` alone takes blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def truncate(ts: Column, unit: str) -> Column:
    """``date_trunc`` that stays a wall-clock time."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def ratio(part: Column, whole: Column) -> Column:
    """Division that gives null, not an error, for a zero divisor."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def not_negative(x: Column) -> Column:
    """Negative becomes 0; null stays null, which ``greatest`` would not keep."""
    return F.when(x < 0, F.lit(0)).otherwise(x)


def none_like(text: Column, patterns: Iterable[str]) -> Column:
    """True when the text matches none of the LIKE patterns; null text gives null.

    One expression, so that long texts are lower-cased and searched once, not per pattern.
    """
    wild = {"%": ".*", "_": "."}
    forms = ("".join(wild.get(c, re.escape(c)) for c in p) for p in patterns)
    # A search needs no leading or trailing ".*".
    parts = [f"^{f}$".removeprefix("^.*").removesuffix(".*$") for f in forms]
    heads = {p[0] for p in parts}
    # Most places in a text start none of the patterns; one test of the character rules them out.
    guard = f"(?=[{''.join(sorted(heads))}])" if all(h.isalnum() for h in heads) else ""
    return ~text.rlike(f"(?s){guard}(?:{'|'.join(parts)})")


def host_name(
    machine: Column,
    forms: Mapping[str, tuple[str, str]] = fixed.HOST_FORMS,
    prefix_length: int = fixed.MACHINE_PREFIX_LENGTH,
) -> Column:
    """Host a machine serves. The number starts after ``prefix_length`` characters in every form."""
    number = F.substring(machine, prefix_length + 1, 2**31 - 1)
    host = F.lit(None).cast("string")
    for part, (before, after) in reversed(forms.items()):
        named = F.concat(F.lit(before), number, F.lit(after))
        host = F.when(machine.contains(part), named).otherwise(host)
    return host


def entry_name(
    machine: Column, alias: str = fixed.ALIAS_PATTERN, prefix: str = fixed.PRODUCTION_PREFIX
) -> Column:
    """Machine name under which a reporting name is listed."""
    digits = F.regexp_replace(machine, "[^0-9]+", "")
    production = F.concat(F.lit(prefix), digits)
    return F.when(machine.like(alias), production).otherwise(machine)


def is_missing(field: T.StructField) -> Column:
    """Empty in the scripting sense: null, empty text, zero, false, empty collection."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType):
        empty = value == ""
    elif isinstance(kind, T.BooleanType):
        empty = ~value
    elif isinstance(kind, T.NumericType):
        empty = value == 0
    elif isinstance(kind, T.ArrayType | T.MapType):
        empty = F.size(value) == 0
    elif isinstance(kind, T.BinaryType):
        empty = F.length(value) == 0
    else:
        empty = F.lit(False)
    return F.coalesce(empty, F.lit(True))
