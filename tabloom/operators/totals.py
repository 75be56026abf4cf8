"""Totals rows and the aggregate functions of tables and pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return c.cast("string")


#: Sample estimators; stddevp and varp are the population ones. count counts what is not blank.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "none": lambda c: F.lit(None),
    "sum": F.sum,
    "min": F.min,
    "minimum": F.min,
    "max": F.max,
    "maximum": F.max,
    "average": F.avg,
    "count": lambda c: F.count_if(c.isNotNull() & (_text(c) != "")),
    "count_numbers": lambda c: F.count_if(c.try_cast("double").isNotNull()),
    "product": F.product,
    "standard_deviation": F.stddev_samp,
    "stddev": F.stddev_samp,
    "stddevp": F.stddev_pop,
    "variance": F.var_samp,
    "var": F.var_samp,
    "varp": F.var_pop,
    "unknown": F.sum,
}


#: These take the numbers among text, and leave the rest out.
NUMERIC = ("sum", "average", "product", "standard_deviation", "stddev", "stddevp", "variance", "var", "varp", "unknown")


def aggregate(function: str | Column, column: str, kind: str | None = None) -> Column:
    """A named function of a column, or a custom aggregate as it is; kind is the column's type, where it is known."""
    if isinstance(function, Column):
        return function
    c = F.col(f"`{column}`")
    return FUNCTIONS[function](c.try_cast("double") if kind == "string" and function in NUMERIC else c)


def totals(df: DataFrame, functions: dict[str, str | Column], labels: dict[str, str] | None = None) -> DataFrame:
    """One row with a column per column of df: its function, its label, or null."""
    labels = labels or {}
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in functions and (isinstance(functions[c], Column) or functions[c] != "none"):
            out.append(aggregate(functions[c], c, types[c]).alias(c))
        else:
            out.append(F.first(F.lit(labels.get(c))).cast("string" if c in labels else types[c]).alias(c))
    return df.agg(*out)


def with_totals(df: DataFrame, functions: dict[str, str | Column], labels: dict[str, str] | None = None) -> DataFrame:
    """Detail rows and the totals row; is_total tells them apart. Columns that labels turn into text are text."""
    total = totals(df, functions, labels)
    detail = df
    for c in labels or {}:
        detail = detail.withColumn(c, F.col(c).cast("string"))
    return detail.withColumn("is_total", F.lit(False)).unionByName(total.withColumn("is_total", F.lit(True)))
