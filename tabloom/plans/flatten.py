"""Nested arrays to rows with fill-down, as one lazy plan of outer explodes.

A row group advances the row; fields of outer levels are filled down over the rows of inner ones, because an explode
repeats them. A parent with an empty or missing child array keeps one row. Sibling arrays stack (a union), they never
multiply; the order comes from positions that the explodes carry, not from partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import WILD, parse_jsonpath
from .infer import RangeSpec


@dataclass(frozen=True)
class Field:
    path: str
    label: str


def labels(paths: list[str]) -> list[Field]:
    """The label is the last key of the path, else field N; repeated labels get a number."""
    out, seen = [], {}
    for k, path in enumerate(paths):
        keys = [s for s in parse_jsonpath(path) if isinstance(s, str) and s != WILD]
        last = parse_jsonpath(path)[-1] if parse_jsonpath(path) else None
        label = keys[-1] if keys and last == keys[-1] else f"field {k}"
        seen[label] = seen.get(label, 0) + 1
        out.append(Field(path, label if seen[label] == 1 else f"{label} {seen[label]}"))
    return out


def _step(c: Column, step: str | int) -> Column:
    if step == WILD:  # an array that is no row group
        return F.get(c, F.lit(0))
    return F.get(c, F.lit(step)) if isinstance(step, int) else c.getField(step)


def _walk(c: Column, steps: list) -> Column:
    for s in steps:
        c = _step(c, s)
    return c


def _starts(steps: list, prefix: list) -> bool:
    return steps[: len(prefix)] == prefix


def flatten(df: DataFrame, column: str, spec: RangeSpec, keep: list[str] | None = None, fields: list[Field] | None = None) -> DataFrame:
    """The rows of one range: keep columns, one column per field, and the positions _p0, _p1, ... that order them."""
    fields = fields or labels(spec.paths)
    keep = keep or []
    groups = sorted((parse_jsonpath(g) for g in spec.row_groups), key=len)
    tops = [g for g in groups if not any(_starts(g, [*o, WILD]) for o in groups if o is not g)]
    branches = _branches(groups, tops)
    depth = max(map(len, branches))
    parts = []
    for number, branch in enumerate(branches):
        out = df.select(*keep, F.col(column).alias("_n0")) if keep else df.select(F.col(column).alias("_n0"))
        before: list = []
        positions = []
        for level, group in enumerate(branch):
            array = _walk(F.col(f"_n{level}"), group[len(before) :])
            out = out.select("*", F.posexplode_outer(array).alias(f"_p{level}", f"_n{level + 1}"))
            before = [*group, WILD]
            positions.append(f"_p{level}")
        columns = []
        for f in fields:
            steps = parse_jsonpath(f.path)
            owner = max((k for k, g in enumerate(branch) if _starts(steps, [*g, WILD])), default=None)
            inside = [g for g in groups if _starts(steps, [*g, WILD])]
            if owner is None and inside or owner is not None and len(inside) > owner + 1:
                columns.append(F.lit(None).alias(f.label))  # a field of a sibling array
                continue
            level = 0 if owner is None else owner + 1
            columns.append(_walk(F.col(f"_n{level}"), steps[len(branch[owner]) + 1 if owner is not None else 0 :]).alias(f.label))
        extra = [F.lit(-1).alias(f"_p{k}") for k in range(len(branch), depth)]
        parts.append(out.select(*keep, *columns, *positions, *extra, F.lit(number).alias("_branch")))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result if len(parts) > 1 else result.drop("_branch")


def row_array(document: Column, spec: RangeSpec, fields: list[Field]) -> Column:
    """The rows of one range of one document, in order, as an array of structs of variants: no sort, no shuffle.

    Chains of groups that begin with the same array take turns within its items, others follow each other.
    """
    groups = sorted((parse_jsonpath(g) for g in spec.row_groups), key=len)
    tops = [g for g in groups if not any(_starts(g, [*o, WILD]) for o in groups if o is not g)]

    def row(branch: list[list], nodes: list[Column]) -> Column:
        columns = []
        for f in fields:
            steps = parse_jsonpath(f.path)
            level = max((k + 1 for k, g in enumerate(branch) if _starts(steps, [*g, WILD])), default=0)
            sibling = sum(_starts(steps, [*g, WILD]) for g in groups) > level
            value = F.lit(None) if sibling else _walk(nodes[level], steps[len(branch[level - 1]) + 1 if level else 0 :])
            columns.append(value.cast("variant").alias(f.label))
        return F.array(F.struct(*columns))

    def rows(branches: list[list[list]], nodes: list[Column]) -> Column:
        level = len(nodes) - 1
        if len(branches) == 1 and len(branches[0]) == level:
            return row(branches[0], nodes)
        group = branches[0][level]
        array = _walk(nodes[level], group[len(branches[0][level - 1]) + 1 if level else 0 :])
        here = F.when(F.size(array) > 0, array).otherwise(F.array(F.lit(None)))  # a parent without items keeps one row

        def inside(x: Column) -> Column:
            # the first group is shared, deeper ones belong to their own chain
            parts = [rows([b], [*nodes, x]) for b in branches]
            return F.concat(*parts) if len(parts) > 1 else parts[0]

        return F.flatten(F.transform(here, inside))

    parts = [rows(_branches(groups, [top]), [document]) for top in tops]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _branches(groups: list[list], tops: list[list]) -> list[list[list]]:
    """Chains of nested row groups, one per innermost group."""

    def below(chain: list[list]) -> list[list[list]]:
        inner = [g for g in groups if _starts(g, [*chain[-1], WILD]) and len(g) > len(chain[-1])]
        direct = [g for g in inner if not any(_starts(g, [*o, WILD]) for o in inner if o is not g)]
        return [b for g in direct for b in below([*chain, g])] or [chain]

    return [b for t in tops for b in below([t])]


def flatten_json(df: DataFrame, column: str, schema: str, spec: RangeSpec, keep: list[str] | None = None) -> DataFrame:
    """The same over JSON text; only fields of the schema are parsed."""
    return flatten(df.withColumn("_doc", F.from_json(column, schema)), "_doc", spec, keep)
