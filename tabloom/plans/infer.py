"""Range inference in nested documents: which arrays or elements repeat, and which values make a table's columns.

Inference runs over the structure (a schema or one document), never over rows. Where each document of a table tells its
own ranges, it runs once for each shape of document.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass
class RangeSpec:
    paths: list[str]
    row_groups: list[str]


@dataclass
class _Node:
    kind: str  # array, object, value
    repeat: bool = False
    children: dict = field(default_factory=dict)
    scalars: dict[int, bool] = field(default_factory=dict)


def _merge(node: _Node | None, value) -> _Node:
    kind = "array" if isinstance(value, list) else "object" if isinstance(value, dict) else "value"
    if node is None or node.kind == "value":
        node = node if node is not None and kind == "value" else _Node(kind)
    if node.kind != kind:
        return node
    if kind == "object":
        for key, child in value.items():
            node.children[key] = _merge(node.children.get(key), child)
    elif kind == "array":
        for k, child in enumerate(value):
            shape = "array" if isinstance(child, list) else "object" if isinstance(child, dict) else None
            if shape is None:
                node.scalars.setdefault(k, True)
                continue
            node.scalars[k] = False
            had = node.children.get(shape)
            node.children[shape] = _merge(had, child)
            if had is not None:  # the second of its shape under the merged node
                node.children[shape].repeat = True
    return node


def json_structure(document) -> _Node:
    """The merged structure of a parsed document."""
    return _merge(None, document)


def structure_lines(node: _Node, name: str = "$") -> list[str]:
    """Canonical dump: $array[3].object(*)['age'].value"""
    label = f"{name}{node.kind}" if name == "$" else name
    if node.kind == "value":
        return [f"{name}.value" if name != "$" else "$value"]
    out = []
    if node.kind == "object":
        for key in sorted(node.children):
            child = node.children[key]
            out += structure_lines_at(child, f"{label}['{key}']")
    else:
        size = len(node.scalars)
        label = f"{label}[{size}]"
        out += [f"{label}[{k}].value" for k in sorted(node.scalars) if node.scalars[k]]
        for shape in ("array", "object"):
            if shape in node.children:
                child = node.children[shape]
                out += structure_lines_at(child, label, child.repeat)
    return out or [label]


def structure_lines_at(node: _Node, prefix: str, repeat: bool = False) -> list[str]:
    mark = "(*)" if repeat else ""
    if node.kind == "value":
        return [f"{prefix}.value"]
    return structure_lines(node, f"{prefix}.{node.kind}{mark}")


def json_ranges(document) -> list[RangeSpec]:
    """Each outermost repeating array is one range; nested repeats join it as more row groups."""
    out: list[RangeSpec] = []

    def visit(node: _Node, path: str, spec: RangeSpec | None) -> None:
        if node.kind == "value":
            if spec is not None:
                spec.paths.append(path)
        elif node.kind == "object":
            for key in sorted(node.children):
                visit(node.children[key], f"{path}['{key}']", spec)
        else:
            for k in sorted(node.scalars):
                if node.scalars[k] and spec is not None:
                    spec.paths.append(f"{path}[{k}]")
            for shape in ("array", "object"):
                child = node.children.get(shape)
                if child is None:
                    continue
                own = spec
                if child.repeat:
                    if own is None:
                        own = RangeSpec([], [])
                        out.append(own)
                    own.row_groups.append(path)
                visit(child, f"{path}[*]", own)

    visit(json_structure(document), "$", None)
    return [s for s in out if s.paths]


def has_range(document) -> bool:
    return bool(json_ranges(document))


def schema_ranges(schema: T.DataType) -> list[RangeSpec]:
    """The same from a Spark schema, where every array of structs or arrays repeats."""
    out: list[RangeSpec] = []

    def visit(kind: T.DataType, path: str, spec: RangeSpec | None) -> None:
        if isinstance(kind, T.StructType):
            for f in sorted(kind.fields, key=lambda f: f.name):
                visit(f.dataType, f"{path}['{f.name}']", spec)
        elif isinstance(kind, T.ArrayType):
            own = spec
            if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
                if own is None:
                    own = RangeSpec([], [])
                    out.append(own)
                own.row_groups.append(path)
                visit(kind.elementType, f"{path}[*]", own)
        elif spec is not None:
            spec.paths.append(path)

    visit(schema, "$", None)
    return [s for s in out if s.paths]


@dataclass
class _Element:
    name: str
    repeat: bool = False
    content: bool = False
    attributes: list[str] = field(default_factory=list)
    children: dict[str, _Element] = field(default_factory=dict)


def xml_structure(root: ET.Element) -> _Element:
    """An element repeats if it stands more than once within one occurrence of its parent."""

    def merge(node: _Element, x: ET.Element) -> None:
        node.attributes += [a for a in x.attrib if a not in node.attributes]
        if (x.text or "").strip() or any((c.tail or "").strip() for c in x):
            node.content = True
        seen: dict[str, int] = {}
        for child in x:
            seen[child.tag] = seen.get(child.tag, 0) + 1
            own = node.children.setdefault(child.tag, _Element(child.tag))
            own.repeat |= seen[child.tag] > 1
            merge(own, child)

    out = _Element(root.tag)
    merge(out, root)
    return out


def xml_ranges(root: ET.Element) -> list[RangeSpec]:
    """Inside a repeat: every attribute, and every leaf with content. A row group names the repeating element."""
    out: list[RangeSpec] = []

    def visit(node: _Element, path: str, spec: RangeSpec | None) -> None:
        if node.repeat:
            if spec is None:
                spec = RangeSpec([], [])
                out.append(spec)
            spec.row_groups.append(path)
        if spec is not None:
            spec.paths += [f"{path}/@{a}" for a in node.attributes]
            if node.content and not node.children:
                spec.paths.append(path)
        for child in node.children.values():
            visit(child, f"{path}/{child.name}", spec)

    top = xml_structure(root)
    visit(top, f"/{top.name}", None)
    return [s for s in out if s.paths]


#: Names, places and paths that a worker remembers at once; beyond, it starts anew with the next document.
REMEMBERED = 200_000


class Numbers(dict):
    """Keys numbered as they come, with the number of parts in all of them."""

    parts = 0

    def __missing__(self, key: tuple) -> int:
        self.parts += 1 + sum(len(x) for x in key if isinstance(x, tuple))
        number = self[key] = len(self) + 1
        return number


class Shapes:
    """What is inferred from documents (ranges, or a map of them), once for all documents of one shape. A shape is a number
    that stands for what inference looks at, so that two documents of the same shape have the same ranges."""

    def __init__(self, shape: Callable, find: Callable):
        self._shape, self._find, self._numbers, self._known = shape, find, Numbers(), {}

    def of(self, document):
        if self._numbers.parts > REMEMBERED:
            self._numbers, self._known = Numbers(), {}
        number = self._shape(document, self._numbers)
        if (found := self._known.get(number)) is None:
            found = self._known[number] = self._find(document)
            self._numbers.parts += found.size()
        return found


def xml_shape(x: ET.Element, numbers: Numbers) -> int:
    """Name, attributes, content, the different shapes of children in order of their first, and the names that repeat."""
    content = bool((text := x.text) and text.strip())
    if not len(x):
        return numbers[x.tag, tuple(x.keys()), content, (), ()]
    inside, names = {}, {}
    for c in x:
        if not content and (text := c.tail) and text.strip():
            content = True
        inside[xml_shape(c, numbers)] = None
        tag = c.tag
        names[tag] = tag in names
    return numbers[x.tag, tuple(x.keys()), content, tuple(inside), tuple([n for n, more in names.items() if more])]


def json_shape(value, numbers: Numbers) -> int:
    """A scalar is 0. An array: its size, where its scalars stand, and the different shapes of the others in order of
    their first, each with whether it comes again: a third of one shape adds nothing to the second."""
    if isinstance(value, dict):
        return numbers["object", tuple([(k, json_shape(v, numbers) if isinstance(v, (dict, list)) else 0) for k, v in value.items()])]
    if isinstance(value, list):
        inside, scalars = {}, []
        for k, child in enumerate(value):
            if isinstance(child, (dict, list)):
                shape = json_shape(child, numbers)
                inside[shape] = shape in inside
            else:
                scalars.append(k)
        return numbers[len(value), tuple(scalars), tuple(inside.items())]
    return 0


def xml_structure_lines(node: _Element, path: str = "") -> list[str]:
    own = f"{path}/{node.name}" + ("[*]" if node.repeat else "")
    return [own, *(f"{own}/@{a}" for a in node.attributes), *(line for c in node.children.values() for line in xml_structure_lines(c, own))]


class Walker:
    """Steps through an inferred structure: root(), descend(step), ascend(), with the kind, repeat and children here."""

    def __init__(self, structure: _Node | _Element):
        self._root, self._path = structure, []

    @property
    def _at(self) -> _Node | _Element:
        return self._path[-1][1] if self._path else self._root

    def root(self) -> Walker:
        self._path = []
        return self

    def descend(self, step: str) -> Walker:
        children = self._at.children
        if step not in children:
            raise ValueError(f"no child {step!r}")
        self._path.append((step, children[step]))
        return self

    def ascend(self) -> Walker:
        if not self._path:
            raise ValueError("already at the root")
        self._path.pop()
        return self

    @property
    def children(self) -> list[str]:
        """Keys of an object, shapes (array, object) inside an array, names of elements."""
        return list(self._at.children)

    @property
    def attributes(self) -> list[str]:
        return list(getattr(self._at, "attributes", []))

    @property
    def kind(self) -> str:
        return getattr(self._at, "kind", "element")

    @property
    def repeat(self) -> bool:
        return self._at.repeat

    @property
    def path(self) -> list[str]:
        return [step for step, _ in self._path]
