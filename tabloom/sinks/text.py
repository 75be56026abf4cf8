"""Text forms of sheets: csv, json rows, check lines, flat grids and html, as columns of lines in row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import column_letters, xml_escape


def csv_field(c: Column) -> Column:
    """Quoted only where a comma, quote or line break is inside; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\n]'), quoted).otherwise(text)


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *(csv_field(F.col(c)) for c in columns))


def json_line(columns: list[str]) -> Column:
    """One row as an object keyed by column letters, blanks null."""
    letters = ["" for _ in columns]
    for k in range(len(columns)):
        n, out = k, ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        letters[k] = out
    return F.to_json(F.struct(*(F.col(c).alias(a) for c, a in zip(columns, letters))), {"ignoreNullFields": "false"})


def check_line() -> Column:
    """sheet/row/col:type:value of a cell."""
    value = F.when(F.col("type") == "string", F.concat(F.lit('"'), F.col("value"), F.lit('"'))).otherwise(F.col("value"))
    return F.concat(F.col("sheet"), F.lit("/"), F.col("row").cast("string"), F.lit("/"), F.col("col").cast("string"), F.lit(":"), F.col("type"), F.lit(":"), value)


def check(cells: DataFrame) -> DataFrame:
    return cells.select("sheet", "row", "col", check_line().alias("line")).orderBy("sheet", "row", "col")


def flat_cell(type_: Column, value: Column) -> Column:
    return F.when(type_ == "numeric", F.concat(value, F.lit(" [v]"))).when(type_ == "boolean", F.concat(value, F.lit(" [b]"))).otherwise(value)


def html_row(columns: list[str]) -> Column:
    cell = lambda c: F.when(F.col(c).isNull(), F.lit('<td class="empty">-</td>')).otherwise(F.concat(F.lit("<td>"), xml_escape(F.col(c).cast("string"), False), F.lit("</td>")))
    return F.concat(F.lit("<tr>"), *(cell(c) for c in columns), F.lit("</tr>"))


def grid(rows: list[list[str]]) -> str:
    """ASCII grid of a small sheet."""
    if not rows:
        return ""
    width = [max(len(r[k]) for r in rows) for k in range(max(map(len, rows)))]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    lines = [rule]
    for r in rows:
        lines += ["|" + "|".join(f" {c.ljust(w)} " for c, w in zip(r, width)) + "|", rule]
    return "\n".join(lines)


def write(df: DataFrame, row: str, columns: list[str], form: str, path: str) -> None:
    """Write a sheet as lines, one part file per range of rows; xml and yaml have no document form."""
    line = {"csv": csv_line, "json": json_line, "html": html_row}[form](columns)
    df.repartitionByRange(row).sortWithinPartitions(row).select(line.alias("value")).write.mode("overwrite").text(path)


__all__ = ["check", "check_line", "column_letters", "csv_field", "csv_line", "flat_cell", "grid", "html_row", "json_line", "write"]
