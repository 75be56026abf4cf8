"""Workbook files (xlsx, ods, gnumeric, Excel 2003 XML) as one long table of cells and side tables of metadata.

Parsers are plain functions of a file's bytes; read_workbooks() runs them one file per task row over the binary source.
"""

from __future__ import annotations

import gzip
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import package


@dataclass
class Cell:
    sheet: str
    row: int
    col: int
    type: str  # numeric, string, boolean, error, formula
    value: str | None = None
    formula: str | None = None
    xf: int | None = None


@dataclass
class Workbook:
    sheets: list[str] = field(default_factory=list)
    cells: list[Cell] = field(default_factory=list)
    strings: list[str] = field(default_factory=list)
    names: list[dict] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    filters: list[dict] = field(default_factory=list)
    merges: list[dict] = field(default_factory=list)
    sizes: list[dict] = field(default_factory=list)
    pivots: list[dict] = field(default_factory=list)
    styles: list[dict] = field(default_factory=list)
    conditions: list[dict] = field(default_factory=list)
    views: list[dict] = field(default_factory=list)
    what_if: list[dict] = field(default_factory=list)
    revisions: list[dict] = field(default_factory=list)
    origin: str = "1899-12-30"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(x: ET.Element, name: str, default: str | None = None) -> str | None:
    for k, v in x.attrib.items():
        if _local(k) == name:
            return v
    return default


def _all(x: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in x.iter() if _local(e.tag) == name)


def _kids(x: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in x if _local(e.tag) == name)


def _first(x: ET.Element, name: str) -> ET.Element | None:
    return next(_all(x, name), None)


def a1(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", text)
    if not m:
        raise ValueError(f"no address: {text!r}")
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def a1_range(text: str) -> tuple[int, int, int, int]:
    first, _, last = text.partition(":")
    return *a1(first), *a1(last or first)


def _letters(col: int) -> str:
    out = ""
    while col >= 0:
        out, col = chr(65 + col % 26) + out, col // 26 - 1
    return out


def shift_formula(text: str, rows: int, columns: int) -> str:
    """A formula as it reads so many cells further: relative references move, absolute ones and strings stay."""

    def move(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        row, col = a1(m[2] + m[4])
        col, row = col if m[1] else col + columns, row if m[3] else row + rows
        return f"{m[1]}{_letters(col)}{m[3]}{row + 1}" if row >= 0 and col >= 0 else "#REF!"

    return re.sub(r"\"[^\"]*\"|'[^']*'!?|(?<![A-Za-z0-9_.$])(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(.])", move, text)


def _area(sheet: str, ref: str) -> dict:
    r1, c1, r2, c2 = a1_range(ref)
    return {"sheet": sheet, "first_row": r1, "first_col": c1, "last_row": r2, "last_col": c2}


def _rich(x: ET.Element) -> str:
    return "".join(t.text or "" for t in _all(x, "t"))


def parse_xlsx(data: bytes) -> Workbook:
    parts, out = package.open_package(data), Workbook()
    xml = lambda name: ET.fromstring(parts[name])

    def relations(part: str) -> dict[str, tuple[str, str]]:
        folder, _, name = part.rpartition("/")
        rels = f"{folder}/_rels/{name}.rels".lstrip("/")
        if rels not in parts:
            return {}
        return {r.attrib["Id"]: (r.attrib["Type"].rpartition("/")[2], package.resolve(part, r.attrib["Target"])) for r in xml(rels) if r.attrib.get("TargetMode") != "External"}

    book = next((t for kind, t in relations("").values() if kind == "officeDocument"), "xl/workbook.xml")
    related = relations(book)
    for kind, target in related.values():
        if kind == "sharedStrings" and target in parts:
            out.strings = [_rich(si) for si in _kids(xml(target), "si")]
        elif kind == "styles" and target in parts:
            out.styles = _xlsx_styles(xml(target))
        elif kind == "pivotCacheDefinition" and target in parts:
            out.pivots.append(cache := _xlsx_pivot_cache(xml(target), target))
            for own, records in relations(target).values():
                if own == "pivotCacheRecords" and records in parts:
                    cache["records"] = [[(_local(v.tag), v.attrib.get("v")) for v in r] for r in _kids(xml(records), "r")]
        elif kind == "revisionHeaders" and target in parts:
            out.revisions += _xlsx_revisions(xml(target), {k: xml(t) for k, (_, t) in relations(target).items() if t in parts})
    root = xml(book)
    if (pr := _first(root, "workbookPr")) is not None and pr.attrib.get("date1904") in ("1", "true"):
        out.origin = "1904-01-01"
    sheets = [(s.attrib["name"], related[_attr(s, "id")][1]) for s in _all(root, "sheet") if _attr(s, "id") in related]
    out.sheets = [n for n, _ in sheets]
    for n in _all(root, "definedName"):
        scope = n.attrib.get("localSheetId")
        out.names.append({"name": n.attrib["name"], "expression": n.text or "", "sheet": out.sheets[int(scope)] if scope is not None else None})
    for name, part in sheets:
        if part in parts:
            _xlsx_sheet(out, name, xml(part))
            for kind, target in relations(part).values():
                if kind == "table" and target in parts:
                    out.tables.append(_xlsx_table(xml(target), name, out))
                elif kind == "pivotTable" and target in parts:
                    out.pivots.append(_xlsx_pivot_table(xml(target), name))
    return out


def _xlsx_revisions(headers: ET.Element, logs: dict[str, ET.Element]) -> list[dict]:
    """Every change of the revision log in order: who, when, what kind, and the cell with its old and new value."""
    out = []
    for h in _all(headers, "header"):
        log = logs.get(_attr(h, "id", ""))
        for x in log if log is not None else ():
            old, new = _first(x, "oc"), _first(x, "nc")
            shown = lambda c: None if c is None else _rich(c) or next((v.text for v in _all(c, "v")), None)
            out.append({"user": h.attrib.get("userName"), "at": h.attrib.get("dateTime"), "number": x.attrib.get("rId"), "kind": _local(x.tag), "sheet_id": x.attrib.get("sId") or x.attrib.get("sheetId"), "ref": new.attrib.get("r") if new is not None else x.attrib.get("ref"), "old": shown(old), "new": shown(new)})
    return out


def parse_part(kind: str, data: bytes, strings: list[str] | None = None) -> Workbook:
    """One part of an xlsx package by itself: sheet (with the shared strings that it refers to), strings, styles or table."""
    root, out = ET.fromstring(data), Workbook(strings=list(strings or []))
    if kind == "sheet":
        out.sheets.append("sheet")
        _xlsx_sheet(out, "sheet", root)
    elif kind == "strings":
        out.strings = [_rich(si) for si in _kids(root, "si")]
    elif kind == "styles":
        out.styles = _xlsx_styles(root)
    elif kind == "table":
        out.tables.append(_xlsx_table(root, "sheet", out))
    else:
        raise ValueError(f"no part {kind}")
    return out


def formula_order(cells: list[Cell]) -> list[Cell]:
    """The formula cells of a sheet so that each comes after those it refers to; a cycle is an error."""
    own = {(c.row, c.col): c for c in cells if c.formula}

    def needs(c: Cell) -> Iterator[tuple[int, int]]:
        for m in re.finditer(r"\"[^\"]*\"|(\$?[A-Za-z]{1,3}\$?\d+)(?::(\$?[A-Za-z]{1,3}\$?\d+))?", c.formula):
            if m[1]:
                (r1, c1), (r2, c2) = a1(m[1]), a1(m[2] or m[1])
                yield from ((r, k) for r, k in own if min(r1, r2) <= r <= max(r1, r2) and min(c1, c2) <= k <= max(c1, c2))

    out, state = [], dict.fromkeys(own, 0)
    for first in own:
        stack = [(first, None)]
        while stack:
            at, todo = stack.pop()
            if todo is None:
                if state[at] == 2:
                    continue
                if state[at] == 1:
                    raise ValueError(f"a circle of formulas at row {at[0]}, column {at[1]}")
                state[at], todo = 1, iter(sorted(set(needs(own[at]))))
            nxt = next(todo, None)
            if nxt is None:
                state[at] = 2
                out.append(own[at])
                continue
            stack.append((at, todo))
            if state[nxt] != 2:
                stack.append((nxt, None))
    return out


def _xlsx_sheet(out: Workbook, sheet: str, root: ET.Element) -> None:
    row_at, shared = -1, {}
    for row in _all(root, "row"):
        row_at = int(row.attrib["r"]) - 1 if "r" in row.attrib else row_at + 1
        if row.attrib.get("hidden") in ("1", "true") or "ht" in row.attrib:
            out.sizes.append({"sheet": sheet, "axis": "row", "first": row_at, "last": row_at, "size": row.attrib.get("ht"), "hidden": row.attrib.get("hidden") in ("1", "true")})
        col_at = -1
        for c in _kids(row, "c"):
            if "r" in c.attrib:
                r, col_at = a1(c.attrib["r"])
                if r != row_at:
                    raise ValueError(f"cell {c.attrib['r']} in row {row_at + 1}")
            else:
                col_at += 1
            kind, xf = c.attrib.get("t", "n"), c.attrib.get("s")
            v, f = next(_kids(c, "v"), None), next(_kids(c, "f"), None)
            text, formula = v.text if v is not None else None, None
            if f is not None:
                formula = f.text
                if f.attrib.get("t") == "shared":
                    text0, r0, c0 = shared.setdefault(f.attrib.get("si"), (formula, row_at, col_at))
                    formula = formula or (shift_formula(text0, row_at - r0, col_at - c0) if text0 else None)
                elif f.attrib.get("t") == "dataTable":
                    out.what_if.append(_area(sheet, f.attrib["ref"]) | {"row_input": f.attrib.get("r1") if f.attrib.get("dtr") == "1" or f.attrib.get("dt2D") == "1" else None, "column_input": f.attrib.get("r2") if f.attrib.get("dt2D") == "1" else None if f.attrib.get("dtr") == "1" else f.attrib.get("r1")})
            type_ = {"s": "string", "n": "numeric", "b": "boolean", "inlineStr": "string", "str": "string", "e": "error", "d": "string"}[kind]
            if kind == "s" and text is not None:
                text = out.strings[int(text)]
            elif kind == "inlineStr":
                text = _rich(c)
            elif kind == "b" and text is not None:
                text = "true" if text == "1" else "false"
            if text is None and formula is None and f is None:
                continue
            out.cells.append(Cell(sheet, row_at, col_at, "formula" if f is not None else type_, text, formula, int(xf) if xf else None))
    for m in _all(root, "mergeCell"):
        out.merges.append(_area(sheet, m.attrib["ref"]))
    for c in _all(root, "col"):
        out.sizes.append({"sheet": sheet, "axis": "col", "first": int(c.attrib["min"]) - 1, "last": int(c.attrib["max"]) - 1, "size": c.attrib.get("width"), "hidden": c.attrib.get("hidden") in ("1", "true")})
    for f in _kids(root, "autoFilter"):
        out.filters.append(_area(sheet, f.attrib["ref"]) | {"items": (items := _xlsx_filter(f)), "tree": _xlsx_tree(items)})
    for cf in _all(root, "conditionalFormatting"):
        for rule in _kids(cf, "cfRule"):
            out.conditions.append({"sheet": sheet, "ref": cf.attrib.get("sqref"), "type": rule.attrib.get("type"), "operator": rule.attrib.get("operator"), "priority": rule.attrib.get("priority"), "formulas": [x.text for x in _kids(rule, "formula")]} | {k: v for k, v in rule.attrib.items() if k in ("rank", "percent", "bottom", "aboveAverage", "equalAverage", "stdDev", "text", "timePeriod")})
    for p in _all(root, "pane"):
        out.views.append({"sheet": sheet, **p.attrib})


def _xlsx_filter(f: ET.Element) -> list[dict]:
    out = []
    for column in _kids(f, "filterColumn"):
        at = int(column.attrib["colId"])
        for x in column:
            kind = _local(x.tag)
            if kind == "filters":
                out.append({"field": at, "op": "set", "values": [y.attrib.get("val") for y in _kids(x, "filter")], "blank": x.attrib.get("blank") == "1"})
            elif kind == "customFilters":
                out.append({"field": at, "op": "and" if x.attrib.get("and") == "1" else "or", "items": [(y.attrib.get("operator", "equal"), y.attrib.get("val")) for y in _kids(x, "customFilter")]})
            elif kind == "top10":
                low, percent = x.attrib.get("top", "1") in ("0", "false"), x.attrib.get("percent") in ("1", "true")
                out.append({"field": at, "op": ("bottom" if low else "top") + ("_percent" if percent else ""), "value": float(x.attrib["val"])})
            elif kind == "dynamicFilter":
                out.append({"field": at, "op": x.attrib.get("type"), "value": x.attrib.get("val")})
    return out


def _xlsx_tree(items: list[dict]) -> list:
    """Filter columns as the plain tree that operators.filters reads; all of them have to pass."""
    out = []
    for i in items:
        if i["op"] == "set":
            out.append(["set", i["field"], i["values"], i["blank"]])
        elif "items" in i:
            out.append([i["op"], [["item", "xlsx", i["field"], op, value] for op, value in i["items"]]])
        elif isinstance(i["value"], float):
            out.append(["item", "own", i["field"], i["op"], i["value"]])
        else:
            out.append(["date", i["field"], i["op"]])
    return ["and", out]


def _xlsx_table(x: ET.Element, sheet: str, out: Workbook) -> dict:
    columns = [{"name": c.attrib["name"], "label": c.attrib.get("totalsRowLabel"), "function": c.attrib.get("totalsRowFunction", "none")} for c in _all(x, "tableColumn")]
    for f in _kids(x, "autoFilter"):
        out.filters.append(_area(sheet, f.attrib["ref"]) | {"items": (items := _xlsx_filter(f)), "tree": _xlsx_tree(items), "table": x.attrib.get("name")})
    return _area(sheet, x.attrib["ref"]) | {"name": x.attrib.get("name"), "display_name": x.attrib.get("displayName"), "totals_rows": int(x.attrib.get("totalsRowCount", 0)), "columns": columns}


def _xlsx_styles(x: ET.Element) -> list[dict]:
    formats = {n.attrib["numFmtId"]: n.attrib["formatCode"] for n in _all(x, "numFmt")}
    fonts = [{_local(p.tag): p.attrib.get("val", "1") for p in f} for fs in _kids(x, "fonts") for f in _kids(fs, "font")]
    fills = [{"pattern": p.attrib.get("patternType")} | {_local(c.tag): c.attrib.get("rgb") or c.attrib.get("theme") or c.attrib.get("indexed") for c in p} for fs in _kids(x, "fills") for f in _kids(fs, "fill") for p in f]
    borders = [{_local(side.tag): side.attrib["style"] for side in b if "style" in side.attrib} for bs in _kids(x, "borders") for b in _kids(bs, "border")]
    named = {c.attrib.get("xfId"): c.attrib.get("name") for cs in _kids(x, "cellStyles") for c in _kids(cs, "cellStyle")}
    at = lambda own, k: own[int(k or 0)] if int(k or 0) < len(own) else {}
    out = []
    for xfs in _kids(x, "cellXfs"):
        for k, xf in enumerate(_kids(xfs, "xf")):
            a = xf.attrib
            inner = {_local(c.tag): dict(c.attrib) for c in xf}
            out.append({
                "xf": k, "number_format": formats.get(a.get("numFmtId", "0"), a.get("numFmtId", "0")), "font": at(fonts, a.get("fontId")), "fill": at(fills, a.get("fillId")), "border": at(borders, a.get("borderId")),
                "style": named.get(a.get("xfId")), "alignment": inner.get("alignment", {}), "protection": inner.get("protection", {}),
            })
    return out


def _xlsx_pivot_cache(x: ET.Element, part: str) -> dict:
    source = _first(x, "worksheetSource")
    fields = []
    for f in _all(x, "cacheField"):
        items = [(_local(i.tag), i.attrib.get("v")) for s in _kids(f, "sharedItems") for i in s]
        group = _first(f, "rangePr")
        fields.append({"name": f.attrib["name"], "items": items, "group": dict(group.attrib) if group is not None else None})
    return {"kind": "cache", "part": part, "sheet": source.attrib.get("sheet") if source is not None else None, "ref": source.attrib.get("ref") or source.attrib.get("name") if source is not None else None, "fields": fields}


def _xlsx_pivot_table(x: ET.Element, sheet: str) -> dict:
    axis = lambda name: [int(f.attrib.get("x", 0)) for g in _kids(x, name) for f in _kids(g, "field")]
    data = [{"field": int(d.attrib["fld"]), "function": d.attrib.get("subtotal", "sum"), "show_as": d.attrib.get("showDataAs", "normal"), "name": d.attrib.get("name")} for d in _all(x, "dataField")]
    page = [{"field": int(p.attrib["fld"]), "item": p.attrib.get("item")} for p in _all(x, "pageField")]
    hidden = [(k, int(i.attrib["x"])) for k, f in enumerate(_all(x, "pivotField")) for i in _all(f, "item") if i.attrib.get("h") == "1" and "x" in i.attrib]
    return {"kind": "table", "sheet": sheet, "name": x.attrib.get("name"), "cache": x.attrib.get("cacheId"), "rows": axis("rowFields"), "columns": axis("colFields"), "data": data, "page": page, "hidden": hidden}


def _ods_area(address: str) -> dict:
    """Sheet and corners of an address such as Sheet1.A1:Sheet1.C9."""
    m = re.fullmatch(r"\$?'?([^'.]*)'?\.(\$?[A-Z]+\$?\d+)(?::(?:\$?'?[^'.]*'?)?\.?(\$?[A-Z]+\$?\d+))?", address)
    return _area(m[1], f"{m[2]}:{m[3] or m[2]}") if m else {"sheet": None}


def _ods_tree(x: ET.Element) -> list:
    kind = _local(x.tag)
    if kind == "filter-condition":
        at, values = int(_attr(x, "field-number", "0")), [_attr(i, "value") for i in _kids(x, "filter-set-item")]
        return ["set", at, values, "" in values] if values else ["item", "odf", at, _attr(x, "operator"), _attr(x, "value")]
    return ["or" if kind == "filter-or" else "and", [_ods_tree(c) for c in x if _local(c.tag).startswith("filter-") and _local(c.tag) != "filter-set-item"]]


def parse_ods(data: bytes) -> Workbook:
    root, out = ET.fromstring(package.open_package(data)["content.xml"]), Workbook()
    if (null := _first(root, "null-date")) is not None:
        out.origin = (_attr(null, "date-value") or out.origin)[:10]
    for table in _all(root, "table"):
        sheet, row_at = _attr(table, "name") or "", 0
        out.sheets.append(sheet)
        for row in _all(table, "table-row"):
            col_at = 0
            for c in row:
                if _local(c.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                repeat = int(_attr(c, "number-columns-repeated", "1"))
                kind, formula = _attr(c, "value-type"), _attr(c, "formula")
                text = "\n".join("".join(p.itertext()) for p in _kids(c, "p"))
                type_, value = "string", text
                if kind in ("float", "percentage", "currency"):
                    type_, value = "numeric", _attr(c, "value")
                elif kind == "date":
                    day = datetime.fromisoformat(_attr(c, "date-value")) - datetime.fromisoformat(out.origin)
                    type_, value = "numeric", repr(day.total_seconds() / 86400)
                elif kind == "time":  # a duration such as PT12H30M00S, as a part of a day
                    m = re.fullmatch(r"-?P(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?", _attr(c, "time-value") or "P")
                    d, h, mi, sec = (float(x or 0) for x in m.groups()) if m else (0.0,) * 4
                    type_, value = "numeric", repr(d + (h * 3600 + mi * 60 + sec) / 86400)
                elif kind == "boolean":
                    type_, value = "boolean", _attr(c, "boolean-value")
                if kind is not None or formula is not None:
                    for k in range(repeat):
                        out.cells.append(Cell(sheet, row_at, col_at + k, "formula" if formula else type_, value, formula))
                down, right = int(_attr(c, "number-rows-spanned", "1")), int(_attr(c, "number-columns-spanned", "1"))
                if down > 1 or right > 1:
                    out.merges.append({"sheet": sheet, "first_row": row_at, "first_col": col_at, "last_row": row_at + down - 1, "last_col": col_at + right - 1})
                col_at += repeat
            row_at += int(_attr(row, "number-rows-repeated", "1"))
    for x in _all(root, "style"):
        if _attr(x, "family") == "table-cell":
            props = {_local(p.tag): {_local(k): v for k, v in p.attrib.items()} for p in x}
            out.styles.append({"xf": len(out.styles), "number_format": _attr(x, "data-style-name"), "font": props.get("text-properties", {}), "fill": {k: v for k, v in props.get("table-cell-properties", {}).items() if k == "background-color"}, "border": {k: v for k, v in props.get("table-cell-properties", {}).items() if k.startswith("border")}, "style": _attr(x, "name"), "alignment": props.get("paragraph-properties", {}), "protection": {k: v for k, v in props.get("table-cell-properties", {}).items() if k == "cell-protect"}})
    for n in _all(root, "named-range"):
        out.names.append({"name": _attr(n, "name"), "expression": _attr(n, "cell-range-address"), "sheet": None})
    for n in _all(root, "named-expression"):
        out.names.append({"name": _attr(n, "name"), "expression": _attr(n, "expression"), "sheet": None})
    for d in _all(root, "database-range"):
        items = [{"field": int(_attr(f, "field-number", "0")), "op": _attr(f, "operator"), "value": _attr(f, "value"), "any": False} for f in _all(d, "filter-condition")]
        own = next(_kids(d, "filter"), None)
        out.filters.append(_ods_area(_attr(d, "target-range-address") or "") | {"name": _attr(d, "name"), "target": _attr(d, "target-range-address"), "items": items, "tree": _ods_tree(own) if own is not None else ["and", []]})
    return out


def _gnumeric_tree(x: ET.Element) -> list:
    at, kind, a = int(x.attrib.get("Index", 0)), x.attrib.get("Type"), x.attrib
    if kind == "bucket":
        op = ("top" if a.get("top", "1") in ("1", "true", "True") else "bottom") + ("" if a.get("items", "1") in ("1", "true", "True") else "_percent")
        return ["item", "own", at, op, float(a.get("count", 10))]
    if kind in ("blanks", "nonblanks"):
        return ["item", "gnumeric", at, kind, None]
    tests = [["item", "gnumeric", at, a[f"Op{k}"], a.get(f"Value{k}", a.get(f"ValueType{k}"))] for k in (0, 1) if f"Op{k}" in a]
    return ["and" if a.get("IsAnd") in ("1", "true", "True") else "or", tests] if tests else ["and", []]


def parse_gnumeric(data: bytes) -> Workbook:
    root, out = ET.fromstring(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data), Workbook()
    kinds = {"20": "boolean", "30": "numeric", "40": "numeric", "50": "error", "60": "string", "80": "array"}
    for s in _all(root, "Sheet"):
        name = next((n.text or "" for n in _kids(s, "Name")), "")
        out.sheets.append(name)
        shared: dict[str, str] = {}
        for c in _all(s, "Cell"):
            kind, text = kinds.get(c.attrib.get("ValueType")), c.text
            formula = None
            if kind is None:
                key = c.attrib.get("ExprID")
                formula = shared.setdefault(key, text) if key and text else shared.get(key, text) if key else text
                out.cells.append(Cell(name, int(c.attrib["Row"]), int(c.attrib["Col"]), "formula", None, formula))
            else:
                value = text.lower() if kind == "boolean" and text else text
                out.cells.append(Cell(name, int(c.attrib["Row"]), int(c.attrib["Col"]), kind, value))
        for m in _all(s, "Merge"):
            out.merges.append(_area(name, m.text))
        for region in _all(s, "StyleRegion"):
            style = next(_kids(region, "Style"), None)
            font = next(_kids(style, "Font"), None) if style is not None else None
            a = dict(style.attrib) if style is not None else {}
            out.styles.append({"xf": len(out.styles), "number_format": a.get("Format"), "font": (dict(font.attrib) | {"name": font.text}) if font is not None else {}, "fill": {k: a[k] for k in ("Back", "PatternColor", "Shade") if k in a}, "border": {_local(b.tag): b.attrib.get("Style") for x in (_kids(style, "StyleBorder") if style is not None else ()) for b in x}, "style": None, "alignment": {k: a[k] for k in ("HAlign", "VAlign", "WrapText") if k in a}, "protection": {k: a[k] for k in ("Locked", "Hidden") if k in a}, "area": {"sheet": name, "first_col": int(region.attrib["startCol"]), "first_row": int(region.attrib["startRow"]), "last_col": int(region.attrib["endCol"]), "last_row": int(region.attrib["endRow"])}})
            for rule in _all(region, "Condition"):
                out.conditions.append({"sheet": name, "ref": f"{_letters(int(region.attrib['startCol']))}{int(region.attrib['startRow']) + 1}:{_letters(int(region.attrib['endCol']))}{int(region.attrib['endRow']) + 1}", "type": "cell", "operator": rule.attrib.get("Operator"), "priority": 0, "formulas": [e.text for e in rule]})
        for f in _all(s, "Filter"):
            items = [{"field": int(x.attrib.get("Index", 0)), "op": x.attrib.get("Op0", x.attrib.get("Type")), "value": x.attrib.get("ValueType0"), "op2": x.attrib.get("Op1"), "value2": x.attrib.get("ValueType1"), "type": x.attrib.get("Type"), "count": x.attrib.get("count")} for x in _kids(f, "Field")]
            out.filters.append(_area(name, f.attrib["Area"]) | {"items": items, "tree": ["and", [_gnumeric_tree(x) for x in _kids(f, "Field")]]})
    for n in _all(root, "Name"):
        if any(_local(k.tag) == "value" for k in n):
            out.names.append({"name": next((k.text for k in _kids(n, "name")), None), "expression": next((k.text for k in _kids(n, "value")), None), "sheet": None})
    return out


def _r1c1_area(sheet: str, ref: str) -> dict:
    m = re.fullmatch(r"R(\d+)C(\d+)(?::R(\d+)C(\d+))?", ref)
    if not m:
        return {"sheet": sheet}
    r1, c1, r2, c2 = (int(x) - 1 for x in (m[1], m[2], m[3] or m[1], m[4] or m[2]))
    return {"sheet": sheet, "first_row": r1, "first_col": c1, "last_row": r2, "last_col": c2}


def parse_xls_xml(data: bytes) -> Workbook:
    root, out = ET.fromstring(package.decode(data).encode()), Workbook()
    plain = lambda e: {_local(k): v for k, v in e.attrib.items()} if e is not None else {}
    for x in (st for sts in _kids(root, "Styles") for st in _kids(sts, "Style")):
        part = {_local(p.tag): p for p in x}
        out.styles.append({"xf": len(out.styles), "number_format": plain(part.get("NumberFormat")).get("Format"), "font": plain(part.get("Font")), "fill": plain(part.get("Interior")), "border": {_attr(b, "Position", ""): _attr(b, "LineStyle") for b in part.get("Borders", ())}, "style": _attr(x, "ID"), "alignment": plain(part.get("Alignment")), "protection": plain(part.get("Protection"))})
    for w in _all(root, "Worksheet"):
        name = _attr(w, "Name") or ""
        out.sheets.append(name)
        table = _first(w, "Table")
        top = int(_attr(table, "TopCell", "1")) - 1 if table is not None else 0
        left = int(_attr(table, "LeftCell", "1")) - 1 if table is not None else 0
        row_at = top - 1
        for row in _kids(table, "Row") if table is not None else ():
            index = _attr(row, "Index")
            row_at = top + int(index) - 1 if index else row_at + 1
            col_at = left - 1
            for c in _kids(row, "Cell"):
                index = _attr(c, "Index")
                col_at = left + int(index) - 1 if index else col_at + 1
                d, formula = next(_kids(c, "Data"), None), _attr(c, "Formula")
                if d is not None or formula:
                    kind, text = _attr(d, "Type") if d is not None else None, "".join(d.itertext()) if d is not None else None
                    type_ = {"Number": "numeric", "DateTime": "numeric", "Boolean": "boolean", "Error": "error"}.get(kind, "string")
                    if kind == "DateTime":
                        text = repr((datetime.fromisoformat(text) - datetime.fromisoformat(out.origin)).total_seconds() / 86400)
                    out.cells.append(Cell(name, row_at, col_at, "formula" if formula else type_, text, formula))
                across, down = int(_attr(c, "MergeAcross", "0")), int(_attr(c, "MergeDown", "0"))
                if across or down:
                    out.merges.append({"sheet": name, "first_row": row_at, "first_col": col_at, "last_row": row_at + down, "last_col": col_at + across})
                col_at += across
        for f in _all(w, "AutoFilter"):
            items = []
            for k, x in enumerate(_kids(f, "AutoFilterColumn")):
                at = int(_attr(x, "Index", str(k + 1))) - 1
                conditions = [(_attr(y, "Operator"), _attr(y, "Value")) for y in _all(x, "AutoFilterCondition")]
                items.append({"field": at, "op": _attr(x, "Type", "All"), "value": _attr(x, "Value"), "items": conditions, "or": _first(x, "AutoFilterOr") is not None})
            tests = [[("or" if i["or"] else "and"), [["item", "xls_xml", i["field"], *c] for c in i["items"]]] if i["items"] else ["item", "xls_xml", i["field"], i["op"], i["value"]] for i in items]
            out.filters.append(_r1c1_area(name, _attr(f, "Range") or "") | {"ref": _attr(f, "Range"), "items": items, "tree": ["and", tests]})
    for n in _all(root, "NamedRange"):
        out.names.append({"name": _attr(n, "Name"), "expression": _attr(n, "RefersTo"), "sheet": None})
    return out


PARSERS = {"xlsx": parse_xlsx, "ods": parse_ods, "gnumeric": parse_gnumeric, "xls_xml": parse_xls_xml}


def _plain(x) -> str | None:
    return None if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True, default=str)


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


_AREA = "first_row long, first_col int, last_row long, last_col int"
_corners = lambda x: (x.get("first_row"), x.get("first_col"), x.get("last_row"), x.get("last_col"))
#: Side tables of a workbook: columns after path, and the rows of one workbook.
TABLES = {
    "cells": ("sheet string, row long, col int, type string, value string, formula string, xf int", lambda b: ((c.sheet, c.row, c.col, c.type, c.value, c.formula, c.xf) for c in b.cells)),
    "sheets": ("sheet string, position int", lambda b: ((n, k) for k, n in enumerate(b.sheets))),
    "strings": ("position int, text string", lambda b: ((k, t) for k, t in enumerate(b.strings))),
    "names": ("name string, expression string, sheet string", lambda b: ((n["name"], n["expression"], n["sheet"]) for n in b.names)),
    "merges": (f"sheet string, {_AREA}", lambda b: ((m["sheet"], *_corners(m)) for m in b.merges)),
    "sizes": ("sheet string, axis string, first long, last long, size double, hidden boolean", lambda b: ((x["sheet"], x["axis"], x["first"], x["last"], _number(x["size"]), bool(x["hidden"])) for x in b.sizes)),
    "tables": (f"sheet string, name string, {_AREA}, totals_rows int, position int, column string, label string, function string", lambda b: ((t["sheet"], t["name"], *_corners(t), t["totals_rows"], k, c["name"], c["label"], c["function"]) for t in b.tables for k, c in enumerate(t["columns"]))),
    "filters": (f"sheet string, name string, {_AREA}, tree string", lambda b: ((f.get("sheet"), f.get("table") or f.get("name"), *_corners(f), _plain(f.get("tree"))) for f in b.filters)),
    "conditions": ("sheet string, ref string, type string, operator string, priority int, formulas array<string>, detail string", lambda b: ((c["sheet"], c["ref"], c["type"], c["operator"], int(c["priority"] or 0), c["formulas"], _plain({k: v for k, v in c.items() if k not in ("sheet", "ref", "type", "operator", "priority", "formulas")})) for c in b.conditions)),
    "styles": ("xf int, number_format string, font string, fill string, border string, style string, alignment string, protection string", lambda b: ((x["xf"], x["number_format"], *(_plain(x.get(k)) for k in ("font", "fill", "border")), x.get("style"), _plain(x.get("alignment")), _plain(x.get("protection"))) for x in b.styles)),
    "formats": (f"sheet string, {_AREA}, xf int", lambda b: _format_runs(b)),
    "views": ("sheet string, detail string", lambda b: ((v["sheet"], _plain({k: x for k, x in v.items() if k != "sheet"})) for v in b.views)),
    "pivot_tables": ("sheet string, name string, cache string, axis string, position int, field int, function string, show_as string", lambda b: _pivot_axes(b)),
    "pivot_fields": ("part string, source_sheet string, source_ref string, field int, name string, position int, kind string, item string", lambda b: ((p["part"], p["sheet"], p["ref"], f, x["name"], k, *item) for p in b.pivots if p["kind"] == "cache" for f, x in enumerate(p["fields"]) for k, item in enumerate(x["items"] or [(None, None)]))),
    "pivot_records": ("part string, record long, field int, index int, value string", lambda b: ((p["part"], r, f, int(v) if kind == "x" else None, None if kind == "x" else v) for p in b.pivots if p["kind"] == "cache" for r, row in enumerate(p.get("records", ())) for f, (kind, v) in enumerate(row))),
    "what_if": (f"sheet string, {_AREA}, row_input string, column_input string", lambda b: ((w["sheet"], *_corners(w), w["row_input"], w["column_input"]) for w in b.what_if)),
    "revisions": ("user string, at string, number string, kind string, sheet_id string, ref string, old string, new string", lambda b: (tuple(r[k] for k in ("user", "at", "number", "kind", "sheet_id", "ref", "old", "new")) for r in b.revisions)),
    "settings": ("origin string, n_sheets int", lambda b: ((b.origin, len(b.sheets)),)),
}


def _format_runs(book: Workbook) -> Iterator[tuple]:
    """Formats by range: declared areas, and runs of neighbouring cells of a row that share one."""
    for s in book.styles:
        if "area" in s:
            yield s["area"]["sheet"], *_corners(s["area"]), s["xf"]
    run: tuple | None = None
    for c in sorted((c for c in book.cells if c.xf is not None), key=lambda c: (c.sheet, c.row, c.col)):
        if run and run[0] == c.sheet and run[1] == c.row and run[3] + 1 == c.col and run[4] == c.xf:
            run = (*run[:3], c.col, c.xf)
            continue
        if run:
            yield run[0], run[1], run[2], run[1], run[3], run[4]
        run = (c.sheet, c.row, c.col, c.col, c.xf)
    if run:
        yield run[0], run[1], run[2], run[1], run[3], run[4]


def _pivot_axes(book: Workbook) -> Iterator[tuple]:
    for p in book.pivots:
        if p["kind"] == "table":
            own = (p["sheet"], p["name"], p["cache"])
            for axis in ("rows", "columns"):
                yield from ((*own, axis, k, f, None, None) for k, f in enumerate(p[axis]))
            yield from ((*own, "data", k, x["field"], x["function"], x["show_as"]) for k, x in enumerate(p["data"]))
            yield from ((*own, "page", k, x["field"], None, x["item"]) for k, x in enumerate(p["page"]))


def workbook_table(files: DataFrame, kind: str, table: str = "cells") -> DataFrame:
    """One side table of every workbook: files has path and content. A malformed file gives no row; see workbook_errors()."""
    parse, (columns, rows_of) = PARSERS[kind], TABLES[table]
    schema = f"path string, {columns}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = iter(rows_of(parse(content)))
                except MALFORMED:
                    continue
                while rows := [(name, *r) for r in islice(found, 20_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


MALFORMED = (ValueError, KeyError, ET.ParseError, OSError, EOFError, package.PackageError, zipfile.BadZipFile)


def workbook_errors(files: DataFrame, kind: str) -> DataFrame:
    """path and error of the files that cannot be read."""
    parse = PARSERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    parse(content)
                except MALFORMED as error:
                    rows.append({"path": name, "error": f"{type(error).__name__}: {error}"[:300]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, error string")


def read_workbooks(spark: SparkSession, path: str, kind: str, table: str = "cells") -> DataFrame:
    """A side table of every file that path matches; cells: path, sheet, row, col, type, value, formula, xf."""
    return workbook_table(spark.read.format("binaryFile").load(path), kind, table)
