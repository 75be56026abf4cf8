"""Documents as trees: load with references, edit-free accessors, and dumps to JSON, XML and YAML."""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from .paths import WILD, parse_jsonpath


def load_json(text: str, folder: str | None = None):
    """A parsed document; with a folder, objects that hold only $ref to a file inside it are replaced by that file."""
    document = json.loads(text)
    return _resolve(document, os.path.realpath(folder)) if folder else document


def _resolve(node, folder: str, within: tuple[str, ...] = ()):
    if isinstance(node, dict):
        if set(node) == {"$ref"} and isinstance(node["$ref"], str) and not node["$ref"].startswith("#"):
            path = os.path.realpath(os.path.join(folder, node["$ref"]))
            if os.path.commonpath([path, folder]) != folder:
                raise ValueError(f"{node['$ref']} is outside the document's folder")
            if path in within:
                raise ValueError(f"{node['$ref']} refers to itself")
            with open(path, encoding="utf-8") as f:
                return _resolve(json.load(f), os.path.dirname(path), (*within, path))
        return {k: _resolve(v, folder, within) for k, v in node.items()}
    if isinstance(node, list):
        return [_resolve(v, folder, within) for v in node]
    return node


def kind(node) -> str:
    if node is None:
        return "null"
    if isinstance(node, bool):
        return "boolean_true" if node else "boolean_false"
    return "number" if isinstance(node, (int, float)) else "string" if isinstance(node, str) else "array" if isinstance(node, list) else "object"


def child_count(node) -> int:
    return len(node) if isinstance(node, (list, dict)) else 0


def keys(node) -> list[str]:
    """The keys of an object in order."""
    if not isinstance(node, dict):
        raise ValueError("only an object has keys")
    return list(node)


def child(node, at: str | int):
    """An element by place or a member by key; one that is missing is an error."""
    if isinstance(node, list) and isinstance(at, int) and 0 <= at < len(node) or isinstance(node, dict) and at in node:
        return node[at]
    raise ValueError(f"no child {at!r}")


def with_value(node, path: str, value):
    """A document with the value at a path replaced or added (at the end of an array); the given one stays as it is."""

    def put(at, steps: list):
        if not steps:
            return value
        step, rest = steps[0], steps[1:]
        if isinstance(step, int):
            if at is None:
                at = []
            if not isinstance(at, list) or step > len(at):
                raise ValueError(f"no element {step}")
            return [*at[:step], put(at[step] if step < len(at) else None, rest), *at[step + 1 :]]
        if step == WILD or not isinstance(at, dict | None):
            raise ValueError(f"no key {step}")
        return (at or {}) | {step: put((at or {}).get(step), rest)}

    return put(node, parse_jsonpath(path))


def without(node, path: str):
    """A document without the element or member at a path."""
    steps = parse_jsonpath(path)
    if not steps:
        raise ValueError("the root stays")

    def drop(at, own: list):
        child(at, own[0])
        if len(own) == 1:
            return at[: own[0]] + at[own[0] + 1 :] if isinstance(at, list) else {k: v for k, v in at.items() if k != own[0]}
        new = drop(at[own[0]], own[1:])
        return [*at[: own[0]], new, *at[own[0] + 1 :]] if isinstance(at, list) else at | {own[0]: new}

    return drop(node, steps)


def dump_json(node, indent: int | None = None) -> str:
    return json.dumps(node, indent=indent, ensure_ascii=False)


def dump_xml(node) -> str:
    """array/item, object/item name=..., number value=..., string value=..., true, false, null."""
    k = kind(node)
    if k == "array":
        return "<array>" + "".join(f"<item>{dump_xml(x)}</item>" for x in node) + "</array>"
    if k == "object":
        return "<object>" + "".join(f"<item name={quoteattr(key)}>{dump_xml(x)}</item>" for key, x in node.items()) + "</object>"
    if k in ("number", "string"):
        return f"<{k} value={quoteattr(_number(node) if k == 'number' else node)}/>"
    return {"null": "<null/>", "boolean_true": "<true/>", "boolean_false": "<false/>"}[k]


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(x)


def dump_yaml(node, depth: int = 0) -> str:
    pad = "  " * depth
    if isinstance(node, (list, dict)) and not node:
        return pad + ("[]" if isinstance(node, list) else "{}") + "\n"
    if isinstance(node, list):
        return "".join(f"{pad}-\n{dump_yaml(x, depth + 1)}" if isinstance(x, (list, dict)) else f"{pad}- {_yaml_scalar(x)}\n" for x in node)
    if isinstance(node, dict):
        return "".join(f"{pad}{_yaml_scalar(k)}:\n{dump_yaml(x, depth + 1)}" if isinstance(x, (list, dict)) else f"{pad}{_yaml_scalar(k)}: {_yaml_scalar(x)}\n" for k, x in node.items())
    return f"{pad}{_yaml_scalar(node)}\n"


def _yaml_scalar(x) -> str:
    if x is None:
        return "~"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return _number(x)
    from ..sources.yaml import scalar

    plain = x and x == x.strip() and scalar(x) == x and not any(c in x for c in ":#[]{},&*!|>'\"%@`\n") and not x.startswith("-")
    return x if plain else json.dumps(x, ensure_ascii=False)


def canonical_xml(text: str) -> list[str]:
    """Compact lines of an XML document: element paths, attributes sorted, text quoted."""
    out = []

    def visit(x: ET.Element, path: str) -> None:
        own = f"{path}/{x.tag}"
        out.append(own)
        out.extend(f"{own}@{k}={json.dumps(v, ensure_ascii=False)}" for k, v in sorted(x.attrib.items()))
        if (x.text or "").strip():
            out.append(f"{own}{json.dumps(x.text.strip(), ensure_ascii=False)}")
        for c in x:
            visit(c, own)
            if (c.tail or "").strip():
                out.append(f"{own}{json.dumps(c.tail.strip(), ensure_ascii=False)}")

    visit(ET.fromstring(text), "")
    return out


def write_back(text: str, edits: dict[str, str]) -> str:
    """XML with the text of the elements at /a/b[n]/c paths replaced, escaped; n counts same-named siblings from 1."""
    root = ET.fromstring(text)
    for path, value in edits.items():
        steps = path.strip("/").split("/")
        if steps[0] != root.tag:
            raise ValueError(f"no {path}")
        target = root if len(steps) == 1 else root.find("/".join(steps[1:]))
        if target is None:
            raise ValueError(f"no {path}")
        target.text = value
    return ET.tostring(root, encoding="unicode")


class XmlWriter:
    """Scoped elements; close() ends the innermost one."""

    def __init__(self):
        self.parts, self.open_ = [], []

    def open(self, name: str, **attributes: str) -> XmlWriter:
        self.parts.append(f"<{name}" + "".join(f" {k}={quoteattr(v)}" for k, v in attributes.items()) + ">")
        self.open_.append(name)
        return self

    def text(self, value: str) -> XmlWriter:
        self.parts.append(escape(value))
        return self

    def close(self) -> XmlWriter:
        self.parts.append(f"</{self.open_.pop()}>")
        return self

    def __str__(self) -> str:
        return "".join(self.parts) + "".join(f"</{n}>" for n in reversed(self.open_))
