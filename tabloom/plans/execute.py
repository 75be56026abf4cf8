"""Map definitions put to work: nested documents to the cells of sheets, with origins, header rows and single cells.

Documents are rows of a DataFrame. A JSON map is a native plan: the paths give a schema with variant leaves, from_json
reads only them, and explodes make the rows. XML, and documents that each tell their own ranges, are walked by an Arrow
worker, one document at a time.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.autotype import NUMERIC
from ..functions.paths import WILD, parse_jsonpath, parse_xpath
from ..operators.filters import free_name
from .flatten import Field, row_array
from .flatten import labels as json_labels
from .mapdef import CellLink, MapDefinition, RangeLink, json_shapes, xml_shapes

_NUMBER = re.compile(NUMERIC)
CELLS = "sheet string, row long, col int, type string, value string"


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=lambda x: int(x) if len(x) < 400 else float(x))


def strict_json(text: str):
    """A document by the standard: no NaN or Infinity, no control characters in strings, nothing after the value."""
    try:
        return _DECODER.decode(text.removeprefix("\ufeff"))
    except RecursionError:
        raise ValueError("nested too deeply") from None


# JSON by a native plan


def leaf_schema(paths: list[str]) -> str:
    """The type of a document that holds these paths, leaves as variants."""
    tree: dict = {}
    for path in paths:
        node = tree
        for step in parse_jsonpath(path):
            node = node.setdefault("[]" if step == WILD or isinstance(step, int) else step, {})

    def kind(node: dict) -> str:
        if not node:
            return "variant"
        if "[]" in node:
            return f"array<{kind(node['[]'])}>"
        return "struct<" + ", ".join(f"`{k}`: {kind(v)}" for k, v in node.items()) + ">"

    return kind(tree)


def _typed(v: Column) -> tuple[Column, Column]:
    """Type and text of a variant; null and containers give no cell."""
    shape = F.schema_of_variant(v)
    type_ = F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "numeric")
    number = F.try_variant_get(v, "$", "double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    text = F.when(type_ == "numeric", F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))).otherwise(F.try_variant_get(v, "$", "string"))
    return type_, text


def _cells_of(rows: DataFrame, keep: list[str], values: list[str], link: RangeLink, row: str) -> DataFrame:
    structs = [F.struct(F.lit(link.column + k).alias("col"), *(x.alias(n) for n, x in zip(("type", "value"), _typed(F.col(v))))) for k, v in enumerate(values)]
    long = rows.select(*keep, F.lit(link.sheet).alias("sheet"), F.col(row).cast("long").alias("row"), F.explode(F.array(*structs)).alias("x"))
    return long.select(*keep, "sheet", "row", "x.*").where("type IS NOT NULL AND value IS NOT NULL AND value <> ''")


def _header(df: DataFrame, keep: list[str], link: RangeLink, names: list[str]) -> DataFrame:
    structs = [F.struct(F.lit(link.column + k).alias("col"), F.lit("string").alias("type"), F.lit(n).alias("value")) for k, n in enumerate(names)]
    return df.select(*keep, F.lit(link.sheet).alias("sheet"), F.lit(link.row).cast("long").alias("row"), F.explode(F.array(*structs)).alias("x")).select(*keep, "sheet", "row", "x.*")


def json_rows(df: DataFrame, column: str, link: RangeLink, keep: list[str], row: str = "row") -> DataFrame:
    """The rows of one range: keep, the row's number in its document from 0, and a variant per field (v0, v1, ...)."""
    parsed = free_name(df, "parsed")
    docs = df.withColumn(parsed, F.from_json(column, leaf_schema([p for p, _ in link.fields] + [f"{g}[*]" for g in link.row_groups if not any(p.startswith(g) for p, _ in link.fields)])))
    fields = [Field(p, f"v{k}") for k, (p, _) in enumerate(link.fields)]
    rows = docs.select(*keep, F.posexplode(row_array(F.col(parsed), link.spec, fields)).alias(row, "_r"))
    return rows.select(*keep, F.col(row).cast("long").alias(row), *(F.col("_r")[f.label].alias(f.label) for f in fields))


def json_cells(df: DataFrame, column: str, m: MapDefinition, keep: list[str]) -> DataFrame:
    """keep, sheet, row, col, type, value of every cell that a map fills; keep names what tells documents apart.

    A document that is no JSON, or misses a path, gives no cell there.
    """
    parts = []
    for link in m.ranges:
        names = [label or auto.label for (_, label), auto in zip(link.fields, json_labels([p for p, _ in link.fields]))]
        rows = json_rows(df, column, link, keep)
        rows = rows.withColumn("row", F.col("row") + link.row + int(link.header))
        parts.append(_cells_of(rows, keep, [f"v{k}" for k in range(len(names))], link, "row"))
        if link.header:
            parts.append(_header(df, keep, link, names))
    for cell in m.cells:
        parsed = F.from_json(column, leaf_schema([cell.path]))
        for step in parse_jsonpath(cell.path):
            parsed = F.get(parsed, F.lit(step)) if isinstance(step, int) else parsed.getField(step)
        one = df.select(*keep, F.lit(0).cast("long").alias("row"), parsed.alias("v0"))
        parts.append(_cells_of(one.withColumn("row", F.lit(cell.row)), keep, ["v0"], RangeLink(cell.sheet, cell.row, cell.column, [(cell.path, None)], []), "row"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# documents walked one at a time


class _Level:
    """A row group of a compiled link: fields with their steps from its item, and the groups directly inside with theirs."""

    __slots__ = ("fields", "inside", "top")

    def __init__(self, fields: list, inside: list, top: bool):
        self.fields, self.inside, self.top = fields, inside, top


@lru_cache(128)
def _json_levels(paths: tuple[str, ...], row_groups: tuple[str, ...]) -> _Level:
    fields = [parse_jsonpath(p) for p in paths]
    groups = [[*parse_jsonpath(g), WILD] for g in row_groups]

    def below(steps: list, prefix: list) -> bool:
        return len(steps) > len(prefix) and steps[: len(prefix)] == prefix

    def level(prefix: list) -> _Level:
        inner = [g for g in groups if below(g, prefix)]
        next_ = [g for g in inner if not any(below(g, o) for o in inner if o is not g)]
        own = [(k, f[len(prefix) :]) for k, f in enumerate(fields) if (f == prefix or below(f, prefix)) and not any(f[: len(g)] == g for g in inner)]
        return _Level(own, [(level(g), g[len(prefix) : -1]) for g in next_], not prefix)

    return level([])


def _json_walk(node, steps: list):
    for s in steps:
        if s == WILD:  # an array that is no row group: its one container
            node = next((x for x in node if isinstance(x, (list, dict))), None) if isinstance(node, list) else None
        elif isinstance(s, int):
            node = node[s] if isinstance(node, list) and s < len(node) else None
        else:
            node = node.get(s) if isinstance(node, dict) else None
    return node


def json_tree_rows(document, link: RangeLink, cell: Callable = lambda x: x) -> Iterator[list]:
    """Rows of a parsed document: values of outer levels are filled down, a parent without children keeps one row.

    Each value passes through cell once, however many rows it fills.
    """

    def emit(node, at: _Level, held: list) -> Iterator[list]:
        held, any_ = list(held), False
        for k, steps in at.fields:
            held[k] = cell(_json_walk(node, steps))
        for level, steps in at.inside:
            array = _json_walk(node, steps)
            for x in array if isinstance(array, list) else ():
                any_ = True
                yield from emit(x, level, held)
        if not any_ and not at.top:
            yield held

    yield from emit(document, _json_levels(tuple(p for p, _ in link.fields), tuple(link.row_groups)), [None] * len(link.fields))


def _json_cell(x) -> tuple[str, str] | None:
    if x is None or isinstance(x, (list, dict)) or x == "":
        return None
    if isinstance(x, bool):
        return "boolean", "true" if x else "false"
    if isinstance(x, (int, float)):
        return "numeric", str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(x)
    return "string", x


def _xml_cell(x: str | None) -> tuple[str, str] | None:
    return (_short_text_cell(x) if len(x) < 25 else _text_cell(x)) if x else None


def _text_cell(x: str) -> tuple[str, str]:
    return ("numeric", _json_cell(float(x))[1]) if _NUMBER.match(x) else ("string", x)


_short_text_cell = lru_cache(16_384)(_text_cell)


def _xml_name(step: str, namespaces: dict[str, str]) -> str:
    alias, _, name = step.rpartition(":")
    uri = namespaces.get(alias)
    if alias and uri is None:
        raise ValueError(f"no namespace {alias}")
    return f"{{{uri}}}{name}" if uri else name


class _Place:
    """An element path of a compiled link: the fields that its text and attributes fill, whether it is a row group, and
    whether one lies below."""

    __slots__ = ("below", "texts", "attributes", "group", "above")

    def __init__(self):
        self.below, self.texts, self.attributes, self.group, self.above = {}, [], [], False, False


@lru_cache(128)
def _xml_places(fields: tuple[str, ...], groups: tuple[str, ...], namespaces: tuple[tuple[str, str], ...]) -> _Place:
    known, root = dict(namespaces), _Place()

    def place(parts: list[str], group: bool = False) -> _Place:
        at = root
        for s in parts:
            at.above |= group
            at = at.below.setdefault(_xml_name(s, known), _Place())
        return at

    for k, p in enumerate(fields):
        parts, attribute = parse_xpath(p)
        at = place(parts)
        if attribute is None:
            at.texts.append(k)
        else:
            at.attributes.append((k, _xml_name(attribute, known) if ":" in attribute else attribute))
    for g in groups:
        place(parse_xpath(g)[0], group=True).group = True
    return root


def xml_tree_rows(root: ET.Element, link: RangeLink, namespaces: dict[str, str], cell: Callable = lambda x: x) -> Iterator[list]:
    """The same over elements; text is trimmed. Without namespaces in the map, names match whatever their namespace.

    Only paths of the link are visited, and each value passes through cell once, however many rows it fills.
    """
    exact = bool(namespaces)

    def scan(x: ET.Element, at: _Place, held: list, found: list) -> None:
        if at.texts:
            text = "".join([x.text or "", *[c.tail or "" for c in x]]) if len(x) else x.text or ""
            value = cell(text.strip())
            for k in at.texts:
                held[k] = value
        for k, name in at.attributes:
            if exact:
                value = x.get(name)
            else:
                value = None
                for a, v in x.items():
                    if a == name or a[0] == "{" and a.rpartition("}")[2] == name:
                        value = v
                        break
            held[k] = cell(value.strip() if value is not None else None)
        if places := at.below:
            for c in x:
                tag = c.tag
                below = places.get(tag.rpartition("}")[2] if tag[0] == "{" and not exact else tag)
                if below is None:
                    continue
                if below.group:
                    found.append((below, c))
                else:
                    scan(c, below, held, found)

    def emit(x: ET.Element, at: _Place, held: list) -> Iterator[list]:
        held, found = list(held), []
        scan(x, at, held, found)
        if found:
            for below, c in found:
                if below.above:
                    yield from emit(c, below, held)
                else:  # one row
                    own = list(held)
                    scan(c, below, own, found)
                    yield own
        elif at.group:
            yield held

    top = _xml_places(tuple(p for p, _ in link.fields), tuple(link.row_groups), tuple(namespaces.items())).below.get(root.tag if exact else root.tag.rpartition("}")[2])
    if top is not None:
        yield from emit(root, top, [None] * len(link.fields))


@lru_cache(4096)
def _label(path: str) -> str:
    parts, attribute = parse_xpath(path)
    return attribute or parts[-1]


@lru_cache(4096)
def _json_label(path: str) -> str:
    return json_labels([path])[0].label


#: Cells that lie side by side: sheet, row, first column, and type and value of each, None where a cell is empty.
Run = tuple[str, int, int, list[tuple[str, str] | None]]


def tree_runs(document, m: MapDefinition, rows: Callable, cell: Callable, label: Callable, single: Callable) -> Iterator[Run]:
    """The cells of a document by rows; rows gives the cells of a link's rows."""
    for link in m.ranges:
        if link.header:
            yield link.sheet, link.row, link.column, [("string", own or label(p)) for p, own in link.fields]
        at = link.row + int(link.header)
        for found in rows(document, link):
            yield link.sheet, at, link.column, found
            at += 1
    for c in m.cells:
        yield c.sheet, c.row, c.column, [cell(single(document, c))]


def _single_cells(runs: Iterator[Run]) -> Iterator[tuple]:
    """(sheet, row, col, type, value) of each."""
    for sheet, row, column, found in runs:
        for k, x in enumerate(found):
            if x is not None:
                yield sheet, row, column + k, *x


def xml_document_runs(root: ET.Element, m: MapDefinition) -> Iterator[Run]:
    def single(x: ET.Element, c: CellLink) -> str | None:
        link = RangeLink(c.sheet, 0, 0, [(c.path, None)], ["/" + "/".join(parse_xpath(c.path)[0])])
        return next((v[0] for v in xml_tree_rows(x, link, m.namespaces)), None)

    return tree_runs(root, m, lambda x, link: xml_tree_rows(x, link, m.namespaces, _xml_cell), _xml_cell, _label, single)


def xml_document_cells(root: ET.Element, m: MapDefinition) -> Iterator[tuple]:
    return _single_cells(xml_document_runs(root, m))


def json_document_runs(document, m: MapDefinition) -> Iterator[Run]:
    def single(x, c: CellLink):
        return next((v[0] for v in json_tree_rows([x], RangeLink("", 0, 0, [("$[*]" + c.path[1:], None)], ["$"]))), None)

    return tree_runs(document, m, lambda x, link: json_tree_rows(x, link, _json_cell), _json_cell, _json_label, single)


def json_document_cells(document, m: MapDefinition) -> Iterator[tuple]:
    return _single_cells(json_document_runs(document, m))


_LONG = pa.schema([("sheet", pa.string()), ("row", pa.int64()), ("col", pa.int32()), ("type", pa.string()), ("value", pa.string())])


def _each(df: DataFrame, column: str, keep: list[str], schema: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """keep and what an Arrow worker makes of each document."""
    own = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    return df.select(*keep, column).mapInArrow(run, f"{own}, {schema}")


def _walked(df: DataFrame, column: str, keep: list[str], runs: Callable[[object], Iterator[Run]]) -> DataFrame:
    """keep and the cells of each document; one that cannot be parsed gives one cell of type error on sheet null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            at, heads, widths, found, failed = [], [], [], [], []

            def made(places: np.ndarray | list, columns: list) -> pa.RecordBatch:
                places = pa.array(places, pa.int64())
                return pa.RecordBatch.from_arrays([k.take(places) for k in keys] + columns, names=[*keep, *_LONG.names])

            def flush() -> pa.RecordBatch:
                size = np.array(widths)
                full = np.fromiter((x is not None for x in found), bool, len(found))
                owner = np.repeat(np.arange(len(size)), size)[full]  # the run of a cell
                column = (np.arange(len(found)) - np.repeat(np.cumsum(size) - size, size))[full]
                sheets, rows, columns = zip(*heads)
                types, values = zip(*filter(None, found)) if len(owner) else ((), ())
                places = [pa.array(sheets, pa.string()).take(pa.array(owner)), pa.array(np.array(rows, np.int64)[owner]), pa.array((np.array(columns)[owner] + column).astype(np.int32))]
                return made(np.array(at)[owner], [*places, pa.array(types, pa.string()), pa.array(values, pa.string())])

            for n, text in enumerate(texts.to_pylist()):
                if text is None:
                    continue
                try:
                    for sheet, row, first, cells in runs(text):
                        at.append(n)
                        heads.append((sheet, row, first))
                        widths.append(len(cells))
                        found += cells
                        if len(found) >= 50_000:
                            yield flush()
                            at, heads, widths, found = [], [], [], []
                except (ValueError, ET.ParseError, RecursionError) as error:
                    failed.append((n, str(error)[:200]))
            if found:
                yield flush()
            if failed:
                places, errors = zip(*failed)
                none = [pa.nulls(len(places), f.type) for f in list(_LONG)[:3]]
                yield made(places, [*none, pa.array(["error"] * len(places), pa.string()), pa.array(errors, pa.string())])

    return _each(df, column, keep, CELLS, run)


def _summed(df: DataFrame, column: str, keep: list[str], runs: Callable[[object], Iterator[Run]]) -> DataFrame:
    """keep, sheet, last_row, numbers: the last row with a cell and the number of numeric cells of each sheet of a document.

    The same as grouping the cells by keep and sheet, but cells stay in the worker that makes them.
    """

    def sums(text) -> dict[str | None, list]:
        out: dict[str | None, list] = {}
        try:
            for sheet, row, _, cells in runs(text):
                numbers = sum([x is not None and x[0] == "numeric" for x in cells])
                if numbers or any(cells):
                    had = out.setdefault(sheet, [row, 0])
                    had[0] = max(had[0], row)
                    had[1] += numbers
        except (ValueError, ET.ParseError, RecursionError):
            out[None] = [None, 0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            found = [(n, sheet, *x) for n, text in enumerate(texts.to_pylist()) if text is not None for sheet, x in sums(text).items()]
            if found:
                places, sheets, rows, numbers = zip(*found)
                made = [pa.array(sheets, pa.string()), pa.array(rows, pa.int64()), pa.array(numbers, pa.int64())]
                yield pa.RecordBatch.from_arrays([k.take(pa.array(places)) for k in keys] + made, names=[*keep, "sheet", "last_row", "numbers"])

    each = _each(df, column, keep, "sheet string, last_row long, numbers long", run)
    return each.groupBy(*keep, "sheet").agg(F.max("last_row").alias("last_row"), F.sum("numbers").alias("numbers"))  # keep may repeat


def xml_cells(df: DataFrame, column: str, m: MapDefinition, keep: list[str]) -> DataFrame:
    """keep, sheet, row, col, type, value of the cells that an XML map fills; column holds text or bytes."""
    return _walked(df, column, keep, lambda text: xml_document_runs(ET.fromstring(text), m))


def _auto_xml_runs(text: str | bytes) -> Iterator[Run]:
    root = ET.fromstring(text)
    return xml_document_runs(root, xml_shapes.of(root))


def _auto_json_runs(text: str) -> Iterator[Run]:
    document = strict_json(text)
    return json_document_runs(document, json_shapes.of(document))


def auto_xml_cells(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Every document by its own ranges, on sheets range-0, range-1, ..."""
    return _walked(df, column, keep, _auto_xml_runs)


def auto_xml_sheets(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep, sheet, last_row, numbers of the sheets that auto_xml_cells fills."""
    return _summed(df, column, keep, _auto_xml_runs)


def auto_json_cells(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return _walked(df, column, keep, _auto_json_runs)


def n_ranges(df: DataFrame, column: str, form: str, keep: list[str]) -> DataFrame:
    """keep and the number of ranges in each document, null where it cannot be parsed; more than none: it has a range."""

    def count(text: str | bytes | None) -> int | None:
        try:
            return None if text is None else len((xml_shapes.of(ET.fromstring(text)) if form == "xml" else json_shapes.of(strict_json(text))).ranges)
        except (ValueError, ET.ParseError, RecursionError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*keys, pa.array([count(t) for t in texts.to_pylist()], pa.int32())], names=[*keep, "n_ranges"])

    return _each(df, column, keep, "n_ranges int", run)
