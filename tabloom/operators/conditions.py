"""Conditional-format rules as boolean, score or bucket columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas
from . import filters

_COMPARE = {"equal": "equal", "not_equal": "not_equal", "less": "less", "less_equal": "less_equal", "greater": "greater", "greater_equal": "greater_equal", "begins_with": "begin_with", "ends_with": "end_with", "contains": "contain", "not_contains": "not_contain", "contains_blanks": "empty"}
DATE_RULES = ("yesterday", "today", "tomorrow", "last_7_days", "last_week", "this_week", "next_week", "last_month", "this_month", "next_month", "last_year", "this_year", "next_year")


def simple_rule(c: Column, rule: str, value=None, numeric: bool = True) -> Column:
    return filters.flag(filters.item_predicate(c, filters.Item(0, _COMPARE[rule], value), "double" if numeric else "string"))


def between(c: Column, low, high, negate: bool = False) -> Column:
    test = filters.flag(c.between(low, high))
    return ~test if negate else test


def duplicate(df: DataFrame, column: str, name: str = "flag", unique: bool = False) -> DataFrame:
    """True where the value stands more than once (unique: just once); blanks are never flagged."""
    n = F.count(F.lit(1)).over(Window.partitionBy(column))
    return df.withColumn(name, F.col(column).isNotNull() & ((n == 1) if unique else (n > 1)))


def top_bottom(df: DataFrame, column: str, n: float, bottom: bool = False, percent: bool = False, name: str = "flag") -> DataFrame:
    op = ("bottom" if bottom else "top") + ("_percent" if percent else "")
    return df.withColumn(name, filters.flag(filters.compile_tree(df, filters.Item(df.columns.index(column), op, n))))


def average(df: DataFrame, column: str, above: bool = True, equal: bool = False, deviations: float = 0.0, name: str = "flag") -> DataFrame:
    c, kind = F.col(column), dict(df.dtypes)[column]
    own = F.when(~F.isnan(c), c) if kind in filters.FRACTIONAL else c
    edge = df.agg(F.avg(own) + (F.stddev_pop(own) * (deviations if above else -deviations) if deviations else 0)).scalar()
    test = (c >= edge if equal else c > edge) if above else (c <= edge if equal else c < edge)
    return df.withColumn(name, filters.flag(test & filters.is_present(c, kind)))


def contains_error(err: Column, negate: bool = False) -> Column:
    return err.isNull() if negate else err.isNotNull()


def expression(formula: str, columns: list[str] | None = None) -> Column:
    """A spreadsheet formula over a range's columns; without columns, an expression of SQL."""
    return filters.flag(F.expr(formula) if columns is None else formulas.formula(formula, columns).cast("boolean"))


def date_rule(c: Column, rule: str, as_of) -> Column:
    return filters.flag(filters.date_predicate(c, filters.DateFilter(0, rule, as_of), "any"))


def _limits(df: DataFrame, column: str, points: list[tuple[str, float | None]]) -> Column:
    """Thresholds p0, p1, ... as one struct: min, max, value, percent or percentile; a scalar subquery finds them."""
    c = F.col(column)
    low, high = F.min(c), F.max(c)
    make = {"min": lambda v: low, "max": lambda v: high, "value": lambda v: F.lit(float(v)), "percent": lambda v: low + (high - low) * (v / 100), "percentile": lambda v: F.percentile(c, F.lit(v / 100))}
    return df.agg(F.struct(*(make[kind](v).cast("double").alias(f"p{k}") for k, (kind, v) in enumerate(points)))).scalar()


def _with_limits(df: DataFrame, column: str, points: list[tuple[str, float | None]], name: str, rule) -> DataFrame:
    """Adds rule(value, thresholds); the thresholds stand in a column of a free name meanwhile."""
    helper = filters.free_name(df, "limits")
    out = df.withColumn(helper, _limits(df, column, points))
    limits = [F.col(helper)[f"p{k}"] for k in range(len(points))]
    return out.withColumn(name, rule(F.col(column).cast("double"), limits)).drop(helper)


def colour_scale(df: DataFrame, column: str, points: list[tuple[str, float | None]], colours: list[tuple[int, int, int]], name: str = "colour") -> DataFrame:
    """rrggbb between the colours of neighbouring points, clamped at the ends."""

    def rule(c: Column, p: list[Column]) -> Column:
        def channel(k: int) -> Column:
            value = F.lit(float(colours[-1][k]))
            for j in reversed(range(len(points) - 1)):
                share = F.when(p[j + 1] > p[j], F.greatest(F.lit(0.0), (c - p[j]) / (p[j + 1] - p[j]))).otherwise(0.0)
                value = F.when(c < p[j + 1], colours[j][k] + (colours[j + 1][k] - colours[j][k]) * share).otherwise(value)
            return F.lpad(F.lower(F.hex(F.floor(value + 0.5).cast("long"))), 2, "0")

        return F.when(c.isNotNull(), F.concat(channel(0), channel(1), channel(2)))

    return _with_limits(df, column, points, name, rule)


def data_bar(df: DataFrame, column: str, min_length: float = 10.0, max_length: float = 90.0, name: str = "bar") -> DataFrame:
    def rule(c: Column, p: list[Column]) -> Column:
        share = F.when(p[1] > p[0], (c - p[0]) / (p[1] - p[0])).otherwise(F.lit(0.0))
        return min_length + (max_length - min_length) * share

    return _with_limits(df, column, [("min", None), ("max", None)], name, rule)


def icon_set(df: DataFrame, column: str, points: list[tuple[str, float | None]], reverse: bool = False, name: str = "icon") -> DataFrame:
    """Number of thresholds reached, from 0; points are the lower bounds of icons 1, 2, ..."""

    def rule(c: Column, p: list[Column]) -> Column:
        icon = sum((F.when(c >= x, 1).otherwise(0) for x in p[1:]), F.when(c >= p[0], 1).otherwise(0))
        return F.when(c.isNotNull(), F.lit(len(points)) - icon if reverse else icon)

    return _with_limits(df, column, points, name, rule)
