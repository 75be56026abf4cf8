"""Path languages: a JSONPath subset and an XPath subset, parsed once on the driver and compiled to columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = "*"


class PathError(ValueError):
    pass


def parse_jsonpath(path: str) -> list[str | int]:
    """$, .key, ['key'], [n], [*] (also []); a negative index, an empty key or anything else is an error."""
    if not path.startswith("$"):
        raise PathError("a path starts with $")
    out, at = [], 1
    token = re.compile(r"\.(?P<key>[^.\[\]'\s]+)|\['(?P<quoted>[^']+)'\]|\[(?P<index>\d+)\]|\[(?P<wild>\*?)\]")
    while at < len(path):
        m = token.match(path, at)
        if not m:
            raise PathError(f"unexpected {path[at:at + 10]!r} at {at}")
        if m["key"] or m["quoted"]:
            out.append(m["key"] or m["quoted"])
        elif m["index"] is not None:
            out.append(int(m["index"]))
        else:
            out.append(WILD)
        at = m.end()
    return out


def format_jsonpath(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) or s == WILD else f"['{s}']" for s in steps)


def json_value(text: Column, path: str, kind: str = "string") -> Column:
    """A value of JSON text by a path; wildcards give the array of values that they meet."""
    steps = parse_jsonpath(path)
    if WILD in steps:
        at = steps.index(WILD)
        base = F.get_json_object(text, format_jsonpath(steps[:at])) if at else text
        items = F.from_json(base, "array<string>")
        rest = format_jsonpath(steps[at + 1 :])
        return items if rest == "$" else F.transform(items, lambda x: json_value(x, rest, kind))
    value = F.get_json_object(text, format_jsonpath(steps))
    return value if kind == "string" else value.try_cast(kind)


def subtree(document, path: str):
    """The part of a parsed document; [*] maps the rest over an array; a missing key or index is an error."""

    def walk(node, steps):
        if not steps:
            return node
        step, rest = steps[0], steps[1:]
        if step == WILD:
            if not isinstance(node, list):
                raise PathError("[*] needs an array")
            return [walk(x, rest) for x in node]
        if isinstance(step, int):
            if not isinstance(node, list) or step >= len(node):
                raise PathError(f"no element {step}")
            return walk(node[step], rest)
        if not isinstance(node, dict) or step not in node:
            raise PathError(f"no key {step}")
        return walk(node[step], rest)

    return walk(document, parse_jsonpath(path))


def parse_xpath(path: str) -> tuple[list[str], str | None]:
    """(elements, attribute) of /a/ns:b/@c; no predicates, wildcards or //."""
    if not path.startswith("/") or path.endswith("/") or "//" in path:
        raise PathError("a path is /a/b or /a/b/@c")
    parts = path[1:].split("/")
    attribute = parts.pop()[1:] if parts[-1].startswith("@") else None
    name = re.compile(r"^[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?$")
    for p in parts + ([attribute] if attribute is not None else []):
        if not name.match(p):
            raise PathError(f"not a name: {p!r}")
    if not parts:
        raise PathError("an attribute needs an element")
    return parts, attribute
