"""The long form of sheets: one row per cell, and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import number_text
from .filters import free_name

CELLS = T.StructType(
    [
        T.StructField("sheet", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("str", T.StringType()),
        T.StructField("bool", T.BooleanType()),
        T.StructField("formula", T.StringType()),
        T.StructField("xf", T.IntegerType()),
    ]
)
#: Row numbers that one array holds at most.
RUN = 10_000
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def to_cells(df: DataFrame, row: str, sheet: str, columns: list[str] | None = None, header: bool = False) -> DataFrame:
    """Unpivot to (sheet, row, col, type, value); blanks give no cell. row names the column of 0-based row numbers."""
    types = dict(df.dtypes)
    columns = columns or [c for c in df.columns if c != row]
    structs = []
    for k, c in enumerate(columns):
        kind = "numeric" if types[c].split("(")[0] in _NUMBERS else "boolean" if types[c] == "boolean" else "string"
        text = number_text(F.col(c).cast("double")) if kind == "numeric" else F.col(c).cast("string")
        structs.append(F.struct(F.lit(k).alias("col"), F.lit(kind).alias("type"), text.alias("value")))
    shift = int(header)
    long = df.select((F.col(row) + shift).alias("row"), F.explode(F.array(*structs)).alias("x")).select(F.lit(sheet).alias("sheet"), F.col("row").cast("long").alias("row"), "x.*")
    out = long.where(F.col("value").isNotNull() & (F.col("value") != ""))
    if header:
        names = df.sparkSession.createDataFrame([(sheet, 0, k, "string", c) for k, c in enumerate(columns)], out.schema)
        out = names.unionByName(out)
    return out


def used_range(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))


def to_wide(cells: DataFrame, n_columns: int, sheet: str | None = None) -> DataFrame:
    """Rows of text c0, c1, ... with blanks as null; every row up to the last used one, blank rows included."""
    own = cells if sheet is None else cells.where(F.col("sheet") == sheet)
    wide = own.groupBy("row").agg(*(F.max(F.when(F.col("col") == k, F.col("value"))).alias(f"c{k}") for k in range(n_columns)))
    last = own.agg(F.max("row").alias("last")).where("last is not null")  # one row; blank rows come RUN at a time
    runs = last.select("last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / RUN))).alias("run"))
    spine = runs.select(F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("last"), (F.col("run") + 1) * RUN - 1))).alias("row"))
    return spine.join(wide, "row", "left")


def fill_down(df: DataFrame, column: str, order: str, partition: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(partition or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def place(cells: DataFrame, row: int, col: int) -> DataFrame:
    """Shift a range to its origin."""
    return cells.withColumn("row", F.col("row") + row).withColumn("col", F.col("col") + col)


def in_intervals(cells: DataFrame, intervals: DataFrame, axis: str, value: str, default=None) -> DataFrame:
    """A value held by runs of rows or columns (widths, heights, hidden flags): intervals(sheet, first, last, value)."""
    own = intervals.select(F.col("sheet").alias("_s"), "first", "last", F.col(value).alias(f"_{value}"))
    test = (cells["sheet"] == own["_s"]) & cells[axis].between(own["first"], own["last"])
    out = cells.join(own, test, "left").drop("_s", "first", "last")
    return out.withColumnRenamed(f"_{value}", value) if default is None else out.withColumn(value, F.coalesce(f"_{value}", F.lit(default))).drop(f"_{value}")


def effective_format(cells: DataFrame, row_formats: DataFrame, column_formats: DataFrame) -> DataFrame:
    """cell, else row, else column, else 0."""
    by_row = in_intervals(cells, row_formats.withColumnRenamed("xf", "row_xf"), "row", "row_xf")
    by_col = in_intervals(by_row, column_formats.withColumnRenamed("xf", "col_xf"), "col", "col_xf")
    return by_col.withColumn("effective_xf", F.coalesce("xf", "row_xf", "col_xf", F.lit(0))).drop("row_xf", "col_xf")


def merged_over(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """merges(sheet, first_row, first_col, last_row, last_col): adds covered, for cells under a merge but not its origin."""
    m = merges.select(F.col("sheet").alias("_s"), "first_row", "first_col", "last_row", "last_col")
    inside = (cells["sheet"] == m["_s"]) & cells["row"].between(m["first_row"], m["last_row"]) & cells["col"].between(m["first_col"], m["last_col"])
    out = cells.join(m, inside, "left")
    covered = F.col("_s").isNotNull() & ~((F.col("row") == F.col("first_row")) & (F.col("col") == F.col("first_col")))
    return out.withColumn("covered", covered).drop("_s", "first_row", "first_col", "last_row", "last_col")


def table_area(df: DataFrame, row: str, area: str, n_rows: int, header_rows: int = 1, totals_rows: int = 0, columns: list[str] | None = None) -> DataFrame:
    """headers, data, totals or all rows of a table whose rows are numbered from 0, and one column or a span of them."""
    first, last = {"headers": (0, header_rows - 1), "data": (header_rows, n_rows - totals_rows - 1), "totals": (n_rows - totals_rows, n_rows - 1), "all": (0, n_rows - 1)}[area]
    out = df.where(F.col(row).between(first, last))
    return out.select(row, *columns) if columns else out


def column_span(columns: list[str], first: str, last: str) -> list[str]:
    a, b = columns.index(first), columns.index(last)
    return columns[min(a, b) : max(a, b) + 1]


def split_sheets(df: DataFrame, row: str, sheet_rows: int, header_rows: int = 0, name: str = "data", split: bool = True) -> DataFrame:
    """Rows placed on sheets of sheet_rows rows: sheet, row_in_sheet. Without split, rows past the first sheet go.

    Header rows stand on every sheet.
    """
    body = sheet_rows - header_rows
    at = F.col(row) - header_rows
    is_header = F.col(row) < header_rows
    number = F.when(is_header, 0).otherwise(F.floor(at / body)).cast("long")
    place_ = F.when(is_header, F.col(row)).otherwise(header_rows + F.pmod(at, F.lit(body))).cast("long")
    n = free_name(df, "sheet_number")
    out = df.withColumns({n: number, "row_in_sheet": place_})
    if not split:
        return out.where(F.col(n) == 0).withColumn("sheet", F.lit(name)).drop(n)
    if header_rows:
        last = df.agg(F.greatest(F.lit(0), F.floor((F.max(row) - header_rows) / body)).cast("long")).scalar()
        heads = out.where(is_header).withColumn(n, last).withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), n)))
        out = out.where(~is_header).unionByName(heads)
    return out.withColumn("sheet", F.when(F.col(n) == 0, F.lit(name)).otherwise(F.concat(F.lit(name + "_"), F.col(n).cast("string")))).drop(n)


def shared_strings(df: DataFrame, columns: list[str], prefix: int = 2) -> DataFrame:
    """The pool of distinct strings with dense ids in code-point order.

    Strings are numbered within their first characters, and the counts of those, a small table, give each start.
    """
    long = df.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("text")).where("text is not null").distinct()
    keyed = long.withColumn("head", F.substring("text", 1, prefix))
    heads = keyed.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    starts = heads.select("head", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    own = keyed.join(starts, "head")
    place_ = F.row_number().over(Window.partitionBy("head").orderBy("text")) - 1
    return own.select("text", (F.col("start") + place_).cast("long").alias("sid"))


def sheets(cells: DataFrame) -> DataFrame:
    """The sheet catalogue: name, number of cells, used rows and columns."""
    return cells.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_cells"), (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def find_table(tables: DataFrame, sheet: str, row: int, col: int) -> DataFrame:
    """The tables(sheet, name, first_row, first_col, last_row, last_col) that hold a cell."""
    return tables.where((F.col("sheet") == sheet) & F.lit(row).between(F.col("first_row"), F.col("last_row")) & F.lit(col).between(F.col("first_col"), F.col("last_col")))


def render(type_: Column, value: Column, err: Column | None = None) -> Column:
    """Text of a cell; a formula without a result is #RES!, an error #ERR!."""
    base = F.when(type_ == "boolean", F.lower(value)).otherwise(value)
    if err is not None:
        base = F.when(err.isNotNull(), "#ERR!").otherwise(base)
    return F.when((type_ == "formula") & value.isNull(), "#RES!").otherwise(base)
