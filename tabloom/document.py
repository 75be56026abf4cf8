"""A workbook of one file as objects: Document, Sheet and Cell, with dumps of sheets and of the import's state.

For single files on the driver; many files are read as DataFrames by tabloom.sources.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from .functions.autotype import NUMERIC
from .sinks.text import grid
from .sources import csv, detect, workbooks
from .sources.workbooks import Workbook, _letters

FORMATS = ("csv", "json", "flat", "html", "check", "none")


@dataclass(frozen=True)
class Cell:
    """type: empty, numeric, string, boolean, error or formula; value as number, text or truth; formula as text."""

    type: str
    value: float | str | bool | None = None
    formula: str | None = None

    def text(self) -> str:
        """As shown: a formula without a result is #RES!."""
        if self.type == "formula" and self.value is None:
            return "#RES!"
        return _shown(self.value)


def _shown(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return value or ""


EMPTY = Cell("empty")


class Sheet:
    def __init__(self, book: Workbook, name: str):
        self.name, self._book = name, book
        self._cells: dict[tuple[int, int], Cell] = {}
        for c in book.cells:
            if c.sheet == name:
                value = c.value
                if value is not None and (c.type == "numeric" or c.type == "formula" and re.match(NUMERIC, value)):
                    value = float(value)
                elif c.type == "boolean" and value is not None:
                    value = value == "true"
                self._cells[c.row, c.col] = Cell(c.type, value, c.formula)

    @property
    def data_size(self) -> tuple[int, int]:
        """Rows and columns of the used range."""
        return (max(r for r, _ in self._cells) + 1, max(c for _, c in self._cells) + 1) if self._cells else (0, 0)

    @property
    def sheet_size(self) -> tuple[int, int]:
        return 1_048_576, 16_384

    def cell(self, row: int, col: int) -> Cell:
        return self._cells.get((row, col), EMPTY)

    def get_rows(self) -> Iterator[tuple[Cell, ...]]:
        """Every row of the used range, blank cells and rows included."""
        rows, columns = self.data_size
        for r in range(rows):
            yield tuple(self.cell(r, c) for c in range(columns))

    def get_named_expressions(self) -> dict[str, str]:
        return {n["name"]: n["expression"] for n in self._book.names if n["sheet"] == self.name}

    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rows and columns that a merged cell covers, by its origin."""
        return {(m["first_row"], m["first_col"]): (m["last_row"] - m["first_row"] + 1, m["last_col"] - m["first_col"] + 1) for m in self._book.merges if m["sheet"] == self.name}

    def dump(self, form: str) -> str:
        return {"csv": self._csv, "json": self._json, "flat": self._flat, "html": self._html, "check": self._check, "none": lambda: ""}[form]()

    def write(self, path: str, form: str = "csv") -> None:
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(self.dump(form))

    def _csv(self) -> str:
        quote = lambda t: '"' + t.replace('"', '""') + '"' if any(c in t for c in ',"\n') else t
        return "".join(",".join(quote(c.text()) for c in row) + "\n" for row in self.get_rows())

    def _json(self) -> str:
        rows = [{_letters(k): c.value for k, c in enumerate(row)} for row in self.get_rows()]
        number = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
        return "[\n" + ",\n".join("  " + json.dumps({k: number(v) for k, v in row.items()}, ensure_ascii=False) for row in rows) + "\n]\n"

    def _flat(self) -> str:
        mark = {"numeric": " [v]", "boolean": " [b]"}
        rows, columns = self.data_size
        return f"rows: {rows}  cols: {columns}\n" + grid([[c.text() + (mark.get(c.type, "") if c.type != "formula" else "") for c in row] for row in self.get_rows()]) + "\n"

    def _html(self) -> str:
        merges = self.merges()
        covered = {(r + i, c + j) for (r, c), (h, w) in merges.items() for i in range(h) for j in range(w)} - set(merges)
        lines = []
        for r, row in enumerate(self.get_rows()):
            cells = []
            for c, cell in enumerate(row):
                if (r, c) in covered:
                    continue
                h, w = merges.get((r, c), (1, 1))
                span = (f' rowspan="{h}"' if h > 1 else "") + (f' colspan="{w}"' if w > 1 else "")
                cells.append(f'<td class="empty"{span}>-</td>' if cell is EMPTY else f"<td{span}>{escape(cell.text())}</td>")
            lines.append("<tr>" + "".join(cells) + "</tr>")
        return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(self.name)}</title></head><body><table>\n" + "\n".join(lines) + "\n</table></body></html>\n"

    def _check(self) -> str:
        """sheet/row/col:type:value of each used cell; a formula with its result, a merged cell with its size."""
        out, merges = [], self.merges()
        for (r, c), cell in sorted(self._cells.items()):
            if cell.type == "formula":
                body = f"formula:{cell.formula}" + (f":{_quoted(cell.value)}" if cell.value is not None else "")
            else:
                body = f"{cell.type}:{_quoted(cell.value)}"
            size = merges.get((r, c))
            out.append(f"{self.name}/{r}/{c}:{body}" + (f":merge=(column={size[1]},row={size[0]})" if size else ""))
        return "".join(line + "\n" for line in out)


def _quoted(value) -> str:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else _shown(value)


class Document:
    def __init__(self, book: Workbook):
        self.book = book
        self.sheets = [Sheet(book, n) for n in book.sheets]

    def sheet(self, name: str) -> Sheet:
        return next(s for s in self.sheets if s.name == name)

    def get_named_expressions(self) -> dict[str, str]:
        return {n["name"]: n["expression"] for n in self.book.names if n["sheet"] is None}

    def check(self) -> str:
        return "".join(s.dump("check") for s in self.sheets)

    def dump(self, folder: str, form: str) -> list[str]:
        """One file a sheet; check and none go to one file and to none."""
        if form not in FORMATS:
            raise ValueError(f"unknown form {form}")
        if form == "none":
            return []
        os.makedirs(folder, exist_ok=True)
        if form == "check":
            path = os.path.join(folder, "check.txt")
            with open(path, "w", encoding="utf-8") as f:
                f.write(self.check())
            return [path]
        suffix = {"csv": "csv", "json": "json", "flat": "txt", "html": "html"}[form]
        paths = []
        for s in self.sheets:
            paths.append(os.path.join(folder, re.sub(r"[/\\\0]", "_", s.name) + "." + suffix))
            s.write(paths[-1], form)
        return paths

    def dump_state(self, folder: str) -> list[str]:
        """What was imported besides cells, as YAML-like JSON lines, a file for each kind of thing."""
        os.makedirs(folder, exist_ok=True)
        paths = []
        for name, (_, rows_of) in workbooks.TABLES.items():
            columns = [c.rpartition(" ")[0].strip("` ") for c in re.split(r",\s*(?![^<]*>)", workbooks.TABLES[name][0])]
            paths.append(os.path.join(folder, f"{name}.jsonl"))
            with open(paths[-1], "w", encoding="utf-8") as f:
                f.writelines(json.dumps(dict(zip(columns, row)), ensure_ascii=False) + "\n" for row in rows_of(self.book))
        return paths


def loads(data: bytes, kind: str | None = None, config: csv.CsvConfig = csv.CsvConfig(), name: str = "data") -> Document:
    """A document from a file's bytes; kind is detected unless it is given, csv always has to be."""
    kind = kind or detect.detect(data)
    if kind == "csv":
        book, number, head = Workbook(sheets=[name]), re.compile(NUMERIC), []
        body = config.sheet_rows - config.header_rows

        def put(sheet: str, r: int, row: list[str]) -> None:
            book.cells += [workbooks.Cell(sheet, r, c, "numeric" if number.match(t) else "string", t) for c, t in enumerate(row) if t != ""]

        for r, row in enumerate(csv.tokenize(data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"), config)):
            if r < config.header_rows:
                head.append(row)
                put(name, r, row)
                continue
            k, at = divmod(r - config.header_rows, body)
            if k and not config.split:
                break
            if k and not at:
                book.sheets.append(f"{name}_{k}")
                for h, x in enumerate(head):
                    put(book.sheets[-1], h, x)
            put(book.sheets[k], config.header_rows + at, row)
        return Document(book)
    if kind not in workbooks.PARSERS:
        raise ValueError(f"no spreadsheet format: {kind}")
    return Document(workbooks.PARSERS[kind](data))


def load(path: str, kind: str | None = None, config: csv.CsvConfig = csv.CsvConfig()) -> Document:
    with open(path, "rb") as f:
        return loads(f.read(), kind, config, os.path.splitext(os.path.basename(path))[0])
