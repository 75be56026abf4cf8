"""Pivot tables: axes, grouping, subtotals, hidden items, page filters and show-data-as."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import free_name
from .totals import aggregate

DATE_PARTS = {"seconds": F.second, "minutes": F.minute, "hours": F.hour, "days": F.dayofyear, "months": F.month, "quarters": F.quarter, "years": F.year}
#: Order of item types on an axis.
ITEM_RANK = ("unknown", "boolean", "date_time", "character", "numeric", "blank", "error")


@dataclass(frozen=True)
class DataField:
    column: str
    function: str = "sum"
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or f"{self.function}_{self.column}"


@dataclass(frozen=True)
class Pivot:
    rows: tuple[str, ...]
    columns: tuple[str, ...] = ()
    data: tuple[DataField, ...] = ()
    page: dict = field(default_factory=dict)
    hidden: dict = field(default_factory=dict)


def page_filter(df: DataFrame, column: str, item=None) -> DataFrame:
    """The rows of one page item; None is all."""
    return df if item is None else df.where(F.col(column) == item)


def hide_items(df: DataFrame, column: str, items: Sequence) -> DataFrame:
    return df.where(F.coalesce(~F.col(column).isin(*items), F.lit(True))) if items else df


def evaluate(df: DataFrame, pivot: Pivot, column_items: Sequence | None = None) -> DataFrame:
    """Row axis by column axis. Known column items save the job that looks them up."""
    for c, item in pivot.page.items():
        df = page_filter(df, c, item)
    for c, items in pivot.hidden.items():
        df = hide_items(df, c, items)
    aggregates = [aggregate(d.function, d.column, dict(df.dtypes).get(d.column)).alias(d.label) for d in pivot.data]
    if not pivot.columns:
        return df.groupBy(*pivot.rows).agg(*aggregates)
    if len(pivot.columns) == 1:
        return df.groupBy(*pivot.rows).pivot(pivot.columns[0], list(column_items) if column_items else None).agg(*aggregates)
    axis = free_name(df, "axis")
    df = df.withColumn(axis, axis_label([F.col(c) for c in pivot.columns]))
    return df.groupBy(*pivot.rows).pivot(axis, list(column_items) if column_items else None).agg(*aggregates)


def axis_label(columns: Sequence[Column]) -> Column:
    """Items of several column fields as one label, joined by |; a | or \\ inside an item is escaped, null is \\N."""
    items = [F.coalesce(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N")) for c in columns]
    return F.concat_ws("|", *items)


def subtotals(df: DataFrame, rows: Sequence[str], data: Sequence[DataField], grand: bool = True) -> DataFrame:
    """Every level of the row axis in one pass; level 0 is detail, the last the grand total."""
    aggregates = [aggregate(d.function, d.column, dict(df.dtypes).get(d.column)).alias(d.label) for d in data]
    out = df.rollup(*rows).agg(*aggregates, F.bit_count(F.grouping_id()).cast("int").alias("level"))
    return out if grand else out.where(F.col("level") < len(rows))


def range_group(c: Column, start: float, end: float, interval: float = 1.0) -> Column:
    """Lower bound of the bucket; values below start and from end on have buckets of their own."""
    bucket = F.lit(float(start)) + F.floor((c - start) / interval) * interval
    text = bucket.cast("double").cast("string")
    return F.when(c < start, F.lit(f"<{float(start)}")).when(c >= end, F.lit(f">={float(end)}")).otherwise(text)


def auto_bounds(df: DataFrame, column: str) -> tuple[float, float]:
    low, high = df.agg(F.min(column), F.max(column)).first()
    return low, high


def auto_range_group(df: DataFrame, column: str, interval: float = 1.0, name: str = "bucket") -> DataFrame:
    """Range groups whose start and end the data give: the least value and the end of the last bucket."""
    c, helper = F.col(column), free_name(df, "start")
    out = df.withColumn(helper, df.agg(F.min(c)).scalar())
    bucket = F.col(helper) + F.floor((c - F.col(helper)) / interval) * interval
    return out.withColumn(name, bucket.cast("double").cast("string")).drop(helper)


def date_group(c: Column, part: str) -> Column:
    """A calendar part, not a truncation."""
    return DATE_PARTS[part](c).cast("int")


def discrete_group(c: Column, groups: dict[str, Sequence]) -> Column:
    """The group that holds the item, else the item itself."""
    out = None
    for name, items in groups.items():
        out = F.when(c.isin(*items), F.lit(name)) if out is None else out.when(c.isin(*items), F.lit(name))
    return out.otherwise(c.cast("string"))


def item_order(kind: Column, value: Column) -> list[Column]:
    return [F.array_position(F.array(*map(F.lit, ITEM_RANK)), kind), value]


def cache_items(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The pivot cache: per field its distinct items with counts; one exchange for all."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("item")) for c in columns))).alias("x")).select("x.*")
    counts = long.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("is_number", F.coalesce(F.col("item").try_cast("double").isNotNull(), F.lit(False)))


def cache_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per field of the cache: distinct items, least and largest number and date, and which kinds of items it holds."""
    types = dict(df.dtypes)
    structs = []
    for c in columns:
        kind, own = types[c], F.col(f"`{c}`")
        date = own.cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else F.lit(None).cast("date")
        text = own.cast("string")
        number = F.lit(None).cast("double") if kind in ("date", "timestamp", "timestamp_ntz", "boolean") else own.try_cast("double")
        structs.append(F.struct(F.lit(c).alias("field"), text.alias("item"), number.alias("number"), date.alias("day")))
    long = df.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
    items = long.groupBy("field", "item").agg(F.max("number").alias("number"), F.max("day").alias("day"))
    blank = F.col("item").isNull() | (F.col("item") == "")
    is_text = ~blank & F.col("number").isNull() & F.col("day").isNull()
    has = lambda test: F.max(F.coalesce(test, F.lit(False)))
    out = items.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("number").alias("min_number"), F.max("number").alias("max_number"), F.min("day").alias("min_date"), F.max("day").alias("max_date"),
        has(blank).alias("has_blank"), has(F.col("number").isNotNull()).alias("has_number"), has(F.col("day").isNotNull()).alias("has_date"), has(is_text).alias("has_text"),
    )
    return out.withColumn("mixed", F.col("has_number").cast("int") + F.col("has_date").cast("int") + F.col("has_text").cast("int") > 1)


def record_items(records: DataFrame, items: DataFrame) -> DataFrame:
    """records(record, field, index or value) with the items(field, index, item) that they point to; a record without an
    index holds its value itself."""
    known = items.select("field", F.col("index").alias("_index"), F.col("item").alias("_item"))
    out = records.join(known, (records["field"] == known["field"]) & (records["index"] == known["_index"]), "left")
    return out.select(records["record"], records["field"], F.coalesce("_item", records["value"]).alias("item"))


def group_items(records: DataFrame, groups: DataFrame, field: str) -> DataFrame:
    """The group item of each record of a base field: groups(base, group_item) by the base item's text."""
    own = records.where(F.col("field") == field)
    return own.join(groups, own["item"] == groups["base"], "left").select("record", "field", "item", F.coalesce("group_item", "item").alias("group_item"))


def leading_blanks(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number of leading labels that repeat the line above; for presentation, after aggregation."""
    w = Window.orderBy(*order)  # over the lines of one printed page of an aggregated table
    same, out = F.lit(True), F.lit(0)
    for c in columns:
        same = same & F.coalesce(F.col(c).eqNullSafe(F.lag(c).over(w)) & (F.row_number().over(w) > 1), F.lit(False))
        out = out + same.cast("int")
    return df.withColumn("leading_blanks", out)


def show_as(df: DataFrame, value: str, kind: str, row: str, column: str, base_item=None, name: str = "shown") -> DataFrame:
    """Show-data-as over an aggregated (row, column, value) table; differences and run totals go along row."""
    v = F.col(value)
    per_column, whole = Window.partitionBy(column), Window.partitionBy()
    along = per_column.orderBy(row)
    if kind == "normal":
        out = v
    elif kind == "percent_of_total":
        out = v / F.sum(v).over(whole)
    elif kind == "percent_of_row":
        out = v / F.sum(v).over(Window.partitionBy(row))
    elif kind == "percent_of_col":
        out = v / F.sum(v).over(per_column)
    elif kind == "run_total":
        out = F.sum(v).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    elif kind == "index":
        out = v * F.sum(v).over(whole) / (F.sum(v).over(Window.partitionBy(row)) * F.sum(v).over(per_column))
    else:
        if base_item in ("previous", "next"):
            base = (F.lag if base_item == "previous" else F.lead)(v).over(along)
        else:
            base = F.max(F.when(F.col(row) == base_item, v)).over(per_column)
        out = {"difference": v - base, "percent": v / base, "percent_diff": (v - base) / base}[kind]
    return df.withColumn(name, out)
