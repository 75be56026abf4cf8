"""Map definitions: which ranges and cells of nested documents go to which sheet; read, inferred and written."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from ..functions.paths import PathError, parse_jsonpath, parse_xpath
from .infer import RangeSpec, Shapes, json_ranges, json_shape, xml_ranges, xml_shape


@dataclass
class CellLink:
    sheet: str
    row: int
    column: int
    path: str


@dataclass
class RangeLink:
    sheet: str
    row: int
    column: int
    fields: list[tuple[str, str | None]]
    row_groups: list[str]
    header: bool = True

    @property
    def spec(self) -> RangeSpec:
        return RangeSpec([p for p, _ in self.fields], self.row_groups)


@dataclass
class MapDefinition:
    sheets: list[str] = field(default_factory=list)
    cells: list[CellLink] = field(default_factory=list)
    ranges: list[RangeLink] = field(default_factory=list)
    namespaces: dict[str, str] = field(default_factory=dict)

    def size(self) -> int:
        return sum(len(r.fields) + len(r.row_groups) for r in self.ranges)

    def check(self, parse) -> MapDefinition:
        """Every path parses, and none is linked twice."""
        seen: set[str] = set()
        for path in [c.path for c in self.cells] + [p for r in self.ranges for p, _ in r.fields]:
            parse(path)
            if path in seen:
                raise PathError(f"linked twice: {path}")
            seen.add(path)
        return self


def read_json_map(text: str) -> MapDefinition:
    raw = json.loads(text)
    if "sheets" not in raw:
        raise ValueError("a map definition needs sheets")
    cells = [CellLink(c["sheet"], c["row"], c["column"], c["path"]) for c in raw.get("cells", [])]
    ranges = [RangeLink(r["sheet"], r["row"], r["column"], [(f["path"], f.get("label")) for f in r["fields"]], [g["path"] for g in r.get("row-groups", [])], r.get("row-header", False)) for r in raw.get("ranges", [])]
    return MapDefinition(raw["sheets"], cells, ranges).check(parse_jsonpath)


def write_json_map(m: MapDefinition) -> str:
    ranges = [{"sheet": r.sheet, "row": r.row, "column": r.column, "row-header": r.header, "fields": [{"path": p} | ({"label": x} if x else {}) for p, x in r.fields], "row-groups": [{"path": g} for g in r.row_groups]} for r in m.ranges]
    return json.dumps({"sheets": m.sheets, "cells": [{"sheet": c.sheet, "row": c.row, "column": c.column, "path": c.path} for c in m.cells], "ranges": ranges}, indent=2)


def _auto(specs: list[RangeSpec]) -> MapDefinition:
    names = [f"range-{k}" for k in range(len(specs))]
    return MapDefinition(names, [], [RangeLink(n, 0, 0, [(p, None) for p in s.paths], s.row_groups) for n, s in zip(names, specs)])


def detect_json_map(document) -> MapDefinition:
    return _auto(json_ranges(document))


def detect_xml_map(text: str) -> MapDefinition:
    return _auto(xml_ranges(ET.fromstring(text)))


#: Maps of documents that tell their own ranges.
json_shapes = Shapes(json_shape, detect_json_map)
xml_shapes = Shapes(xml_shape, lambda root: _auto(xml_ranges(root)))


def read_xml_map(text: str) -> MapDefinition:
    out = MapDefinition()
    for x in ET.fromstring(text):
        a = x.attrib
        if x.tag == "ns":
            out.namespaces[a["alias"]] = a["uri"]
        elif x.tag == "sheet":
            out.sheets.append(a["name"])
        elif x.tag == "cell":
            out.cells.append(CellLink(a["sheet"], int(a["row"]), int(a["column"]), a["path"]))
        elif x.tag == "range":
            fields = [(f.attrib["path"], f.attrib.get("label")) for f in x.findall("field")]
            out.ranges.append(RangeLink(a["sheet"], int(a["row"]), int(a["column"]), fields, [g.attrib["path"] for g in x.findall("row-group")]))
    return out.check(parse_xpath)


def write_xml_map(m: MapDefinition) -> str:
    root = ET.Element("map")
    for alias, uri in m.namespaces.items():
        ET.SubElement(root, "ns", alias=alias, uri=uri)
    for s in m.sheets:
        ET.SubElement(root, "sheet", name=s)
    for c in m.cells:
        ET.SubElement(root, "cell", sheet=c.sheet, row=str(c.row), column=str(c.column), path=c.path)
    for r in m.ranges:
        own = ET.SubElement(root, "range", sheet=r.sheet, row=str(r.row), column=str(r.column))
        for p, label in r.fields:
            ET.SubElement(own, "field", {"path": p} | ({"label": label} if label else {}))
        for g in r.row_groups:
            ET.SubElement(own, "row-group", path=g)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")
