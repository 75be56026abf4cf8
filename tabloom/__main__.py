"""Command line: python -m tabloom COMMAND FILE ...; one file on the driver, text to the standard output or a folder."""

from __future__ import annotations

import argparse
import json
import sys
import xml.etree.ElementTree as ET

from . import document
from .functions import trees
from .plans import execute, infer, mapdef
from .sources import css, csv, detect, package, workbooks, yaml


def _sheets(doc: document.Document, args: argparse.Namespace) -> None:
    if args.output:
        print("\n".join(doc.dump(args.output, args.form)))
    else:
        for s in doc.sheets:
            print(s.dump(args.form), end="")
    if getattr(args, "state", None):
        doc.dump_state(args.state)


def _cells_document(cells) -> document.Document:
    book = workbooks.Workbook()
    for sheet, row, col, type_, value in cells:
        if sheet not in book.sheets:
            book.sheets.append(sheet)
        book.cells.append(workbooks.Cell(sheet, row, col, type_, value))
    return document.Document(book)


def run_sheet(args: argparse.Namespace, data: bytes) -> None:
    config = csv.CsvConfig(args.delimiters, args.qualifier, args.trim, args.row_header, args.row_size, args.split)
    _sheets(document.loads(data, args.command if args.command != "sheet" else None, config), args)


def run_json(args: argparse.Namespace, data: bytes) -> None:
    node = trees.load_json(package.decode(data), args.references) if args.references else execute.strict_json(package.decode(data))
    if args.mode == "convert":
        print({"json": lambda: trees.dump_json(node, 4), "xml": lambda: trees.dump_xml(node), "yaml": lambda: trees.dump_yaml(node), "none": lambda: ""}[args.to]())
    elif args.mode == "structure":
        print("\n".join(infer.structure_lines(infer.json_structure(node))))
    elif args.mode == "map-gen":
        print(mapdef.write_json_map(mapdef.detect_json_map(node)))
    elif args.mode == "subtree":
        from .functions.paths import subtree

        print(trees.dump_json(subtree(node, args.path), 4))
    else:
        m = mapdef.read_json_map(open(args.map, encoding="utf-8").read()) if args.map else mapdef.detect_json_map(node)
        _sheets(_cells_document(execute.json_document_cells(node, m)), args)


def run_xml(args: argparse.Namespace, data: bytes) -> None:
    if args.mode == "dump":
        print("\n".join(trees.canonical_xml(package.decode(data))))
    elif args.mode == "structure":
        print("\n".join(infer.xml_structure_lines(infer.xml_structure(ET.fromstring(data)))))
    elif args.mode == "map-gen":
        print(mapdef.write_xml_map(mapdef.detect_xml_map(package.decode(data))))
    else:
        m = mapdef.read_xml_map(open(args.map, encoding="utf-8").read()) if args.map else mapdef.detect_xml_map(package.decode(data))
        _sheets(_cells_document(execute.xml_document_cells(ET.fromstring(data), m)), args)


def run_yaml(args: argparse.Namespace, data: bytes) -> None:
    for node in yaml.parse(package.decode(data)):
        print({"yaml": lambda: trees.dump_yaml(node), "json": lambda: trees.dump_json(node, 4), "none": lambda: ""}[args.to]())


def run_other(args: argparse.Namespace, data: bytes) -> None:
    if args.command == "detect":
        print(detect.detect(data))
    elif args.command == "css":
        for rule in css.parse(package.decode(data)):
            print(json.dumps(rule, ensure_ascii=False))
    else:
        for name, body in package.open_package(data).items():
            print(f"{len(body):>12} {name}")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tabloom")
    commands = out.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("file")
    common.add_argument("-f", "--form", choices=document.FORMATS, default="flat", help="form of the sheets")
    common.add_argument("-o", "--output", help="folder for the sheets")
    common.add_argument("--state", help="folder for what was imported besides cells")
    for name in ("sheet", "csv", "xlsx", "ods", "gnumeric", "xls_xml"):
        c = commands.add_parser(name, parents=[common], help="cells of a spreadsheet file")
        c.set_defaults(run=run_sheet)
        c.add_argument("--delimiters", default=",")
        c.add_argument("--qualifier", default='"')
        c.add_argument("--trim", action="store_true")
        c.add_argument("--row-header", type=int, default=0)
        c.add_argument("--row-size", type=int, default=1_048_576)
        c.add_argument("--split", action="store_true")
    for name, modes, run in (("json", ("convert", "map", "map-gen", "structure", "subtree"), run_json), ("xml", ("map", "dump", "map-gen", "structure"), run_xml)):
        c = commands.add_parser(name, parents=[common])
        c.set_defaults(run=run)
        c.add_argument("--mode", choices=modes, default=modes[0])
        c.add_argument("-m", "--map", help="map definition; else the document's own ranges")
        if name == "json":
            c.add_argument("--to", choices=("json", "xml", "yaml", "none"), default="json")
            c.add_argument("--path", default="$")
            c.add_argument("--references", help="folder in which external references are looked up")
    c = commands.add_parser("yaml", parents=[common])
    c.add_argument("--to", choices=("yaml", "json", "none"), default="yaml")
    c.set_defaults(run=run_yaml)
    for name in ("detect", "css", "zip"):
        commands.add_parser(name, parents=[common]).set_defaults(run=run_other)
    return out


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        with open(args.file, "rb") as f:
            args.run(args, f.read())
    except (OSError, ValueError, KeyError, ET.ParseError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
