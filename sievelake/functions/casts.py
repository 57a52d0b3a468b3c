"""Casts that never fail: what cannot be read is zero, false or empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed spellings of booleans.
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """A string as double, null unless it is a plain decimal number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def cast_int64(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long")), F.lit(0).cast("long"))


def cast_float64(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0.0))


def cast_bool(text: Column) -> Column:
    return F.coalesce(text.isin(*TRUE_WORDS), F.lit(False))


def cast_string(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def sanitize_field(name: Column) -> Column:
    """Only letters, digits and dots of a field name."""
    return F.regexp_replace(name, "[^a-zA-Z0-9.]", "")


RESERVED = ("raw", "@timestamp")


def validate_reserved_field(name: str, allow_empty: bool = False) -> None:
    if not name and not allow_empty:
        raise ValueError("a field name is needed")
    if name in RESERVED:
        raise ValueError(f"{name} is reserved")
