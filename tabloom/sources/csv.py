"""CSV in exact mode: several delimiters, blank lines are rows, doubled qualifiers, rows end on a line feed only.

Whole files are read by the binary source, one task per file; spark.read.csv stays the fast mode for plain files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.autotype import auto_cell


class CsvError(ValueError):
    pass


@dataclass(frozen=True)
class CsvConfig:
    delimiters: str = ","
    qualifier: str = '"'
    trim: bool = False
    header_rows: int = 0
    sheet_rows: int = 1_048_576
    split: bool = False


def tokenize(text: str, config: CsvConfig = CsvConfig()) -> Iterator[list[str]]:
    """Rows of cells. An error ends the file: rows before it have been given already."""
    text = text.removeprefix("﻿")
    at, n, row = 0, len(text), []
    delimiters, q = set(config.delimiters), config.qualifier
    strip = (lambda s: s.strip(" \t")) if config.trim else (lambda s: s)
    while at < n:
        if config.trim:
            while at < n and text[at] in " \t" and text[at] not in delimiters:
                at += 1
        if at < n and text[at] == q:
            at += 1
            parts, doubled = [], False
            while True:
                end = text.find(q, at)
                if end < 0:
                    if doubled:
                        raise CsvError("quoted cell without an end")
                    parts.append(text[at:])
                    at = n
                    break
                parts.append(text[at:end])
                at = end + 1
                if at < n and text[at] == q:
                    parts.append(q)
                    doubled, at = True, at + 1
                    continue
                break
            row.append("".join(parts))
            if config.trim:
                while at < n and text[at] in " \t" and text[at] not in delimiters:
                    at += 1
            if at < n and text[at] not in delimiters and text[at] != "\n":
                raise CsvError(f"expected a delimiter, not {text[at]!r}")
        else:
            start = at
            while at < n and text[at] != "\n" and text[at] not in delimiters:
                at += 1
            if at > start or at < n and (text[at] in delimiters or row):
                row.append(strip(text[start:at]))
        if at >= n:
            break
        if text[at] == "\n":
            yield row
            row = []
        at += 1
    if row:
        yield row


_SCHEMA = pa.schema([("path", pa.string()), ("row", pa.int64()), ("col", pa.int32()), ("text", pa.string())])


def csv_cells(files: DataFrame, config: CsvConfig = CsvConfig(), encoding: str = "utf-8") -> DataFrame:
    """path, row, col, text of every cell of files (path, content); a file with an error keeps the rows before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = "utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else encoding
                cells: list[tuple] = []
                try:
                    for k, row in enumerate(tokenize(content.decode(own), config)):
                        cells += [(name, k, j, c) for j, c in enumerate(row)]
                        if len(cells) > 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*cells), _SCHEMA)], schema=_SCHEMA)
                            cells = []
                except (CsvError, UnicodeDecodeError):
                    pass  # rows so far stay; csv_errors() names the file
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*cells), _SCHEMA)], schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, "path string, row long, col int, text string")


def csv_errors(files: DataFrame, config: CsvConfig = CsvConfig(), encoding: str = "utf-8") -> DataFrame:
    """path and error of the files that are not read to their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for _ in tokenize(content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else encoding), config):
                        pass
                except (CsvError, UnicodeDecodeError) as error:
                    rows.append({"path": name, "error": str(error)[:300]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, error string")


def on_sheets(cells: DataFrame, config: CsvConfig, name: str = "data") -> DataFrame:
    """path, sheet, row, col, type, num, str: cells typed and placed on sheets of config.sheet_rows rows.

    With split, further rows go to name_1, name_2, ... and header rows stand on each; without, they go.
    """
    header, body = config.header_rows, config.sheet_rows - config.header_rows
    if body < 1:
        raise ValueError("a sheet has room for its header rows alone")
    typed = cells.select("path", "row", "col", auto_cell(F.col("text")).alias("x")).select("path", "row", "col", "x.*").where("type <> 'empty'")
    is_header = F.col("row") < header
    number = F.when(is_header, 0).otherwise(F.floor((F.col("row") - header) / body)).cast("long")
    place = F.when(is_header, F.col("row")).otherwise(header + F.pmod(F.col("row") - header, F.lit(body))).cast("long")
    placed = typed.withColumns({"number": number, "place": place})
    if not config.split:
        placed = placed.where("number = 0")
    elif header:
        last = cells.groupBy("path").agg(F.greatest(F.lit(0), F.floor((F.max("row") - header) / body)).cast("long").alias("last"))
        heads = placed.where(is_header).join(last, "path").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
        placed = placed.where(~is_header).unionByName(heads)
    sheet = F.when(F.col("number") == 0, F.lit(name)).otherwise(F.concat(F.lit(name + "_"), F.col("number").cast("string")))
    return placed.select("path", sheet.alias("sheet"), F.col("place").alias("row"), "col", "type", "num", "str")


def read_csv(spark: SparkSession, path: str, config: CsvConfig = CsvConfig(), encoding: str = "utf-8") -> DataFrame:
    """The typed cells of every file that path matches, on sheets."""
    return on_sheets(csv_cells(spark.read.format("binaryFile").load(path), config, encoding), config)


def read_csv_fast(spark: SparkSession, path: str, config: CsvConfig = CsvConfig()) -> DataFrame:
    """The built-in reader: splits files, one delimiter, no blank rows."""
    return spark.read.csv(path, sep=config.delimiters[0], quote=config.qualifier, escape=config.qualifier, header=config.header_rows > 0, multiLine=True)
