"""Cell typing of text: a whole number in plain or scientific notation becomes a double, anything else stays text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMERIC), F.lit(False))


def auto_number(text: Column) -> Column:
    return F.when(is_number(text), text.try_cast("double"))


def auto_type(text: Column) -> Column:
    """empty (null or no characters), numeric or string."""
    return F.when(text.isNull() | (text == ""), "empty").when(is_number(text), "numeric").otherwise("string")


def auto_cell(text: Column) -> Column:
    """struct<type, num, str> of one piece of text."""
    kind = auto_type(text)
    return F.struct(kind.alias("type"), auto_number(text).alias("num"), F.when(kind == "string", text).alias("str"))
