"""Filter trees over the columns of a range, compiled to native predicates that reach the scan.

A tree is made of Item, ItemSet, DateFilter and Node; a field is the 0-based place of a column. Blank cells are null or
empty text: positive text and number tests fail on them, negative ones pass. Not-a-number counts as blank for number
tests, ranks and averages. Top and bottom rules keep ties. Ranked rules compare with a threshold that a scalar subquery
finds, so no window spans the range.

Predicates may be null where a test fails on a blank; a filter drops such rows, and flag() turns them into false.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARISONS = ("greater", "greater_equal", "less", "less_equal")
RANKED = ("top", "bottom", "top_percent", "bottom_percent", "top_percent_range", "bottom_percent_range")
TEXT = ("contain", "not_contain", "begin_with", "not_begin_with", "end_with", "not_end_with")
DYNAMIC = ("above_average", "below_average")


@dataclass(frozen=True)
class Item:
    field: int
    op: str
    value: str | float | None = None
    regex: bool = False


@dataclass(frozen=True)
class ItemSet:
    field: int
    values: tuple
    blank: bool = False


@dataclass(frozen=True)
class Node:
    op: str  # and, or
    children: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class DateFilter:
    """A dynamic date rule against an explicit day."""

    field: int
    name: str
    as_of: date | None = None


def rewrite_wildcard(op: str, pattern: str) -> tuple[str, str, bool]:
    """(op, value, regex) for equal and not_equal with * and ?; ~* and ~? are literal. Other operators stay."""
    if op not in ("equal", "not_equal"):
        return op, pattern, False
    tokens = re.findall(r"~[*?~]|[*?]|[^*?~]+|~", pattern)
    wild = [t in "*?" and len(t) == 1 for t in tokens]
    literal = "".join(t[1] if len(t) == 2 and t[0] == "~" else t for t, w in zip(tokens, wild) if not w)
    if not any(wild):
        return op, literal, False
    if tokens == ["*"]:
        return op, ".*", True
    stars = [t == "*" for t in tokens]
    inner = [t for t, w in zip(tokens[1:-1], wild[1:-1]) if w]
    negative = "not_" if op == "not_equal" else ""
    if not inner and "?" not in (tokens[0], tokens[-1]):
        if stars[0] and stars[-1]:
            return negative + "contain", literal, False
        if stars[0]:
            return negative + "end_with", literal, False
        if stars[-1]:
            return negative + "begin_with", literal, False
    body = "".join({"*": ".*", "?": "."}.get(t) if w else re.escape(t[1] if len(t) == 2 and t[0] == "~" else t) for t, w in zip(tokens, wild))
    return op, body, True


FRACTIONAL = ("float", "double")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_number_type(kind: str) -> bool:
    return kind.split("(")[0] in _NUMBERS


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (base, *(f"{base}_{k}" for k in range(len(taken) + 1))) if n not in taken)


def flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def is_blank(c: Column, kind: str = "string") -> Column:
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def is_present(c: Column, kind: str) -> Column:
    """Neither null nor not-a-number."""
    return c.isNotNull() & ~F.isnan(c) if kind in FRACTIONAL else c.isNotNull()


def _unless(c: Column, test: Column) -> Column:
    """A negative test: blanks pass it."""
    return c.isNull() | ~test


def item_predicate(c: Column, item: Item, kind: str = "string") -> Column:
    """Predicate of one item without a rank; kind is the column's type."""
    op, value, number_type = item.op, item.value, is_number_type(kind)
    if op == "empty":
        return is_blank(c, kind)
    if op == "not_empty":
        return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()
    number = c if number_type else c.try_cast("double")
    if op in COMPARISONS:
        if isinstance(value, str):
            raise ValueError(f"{op} takes a number")
        test = {"greater": number > value, "greater_equal": number >= value, "less": number < value, "less_equal": number <= value}[op]
        fractional = kind in FRACTIONAL or not number_type
        return test & ~F.isnan(number) if fractional and op.startswith("greater") else test
    text = c if kind == "string" else c.cast("string")
    if op in ("equal", "not_equal"):
        if item.regex:
            test = text.rlike(f"^(?:{value})$")
        elif isinstance(value, bool):
            test = c == F.lit(value)
        elif isinstance(value, (int, float)):
            test = number == value
            return number.isNull() | (number != value) if op == "not_equal" else test
        else:
            test = text == value
        return _unless(c, test) if op == "not_equal" else test
    if op in TEXT:
        plain = op.removeprefix("not_")
        if item.regex:
            test = text.rlike({"contain": "{}", "begin_with": "^(?:{})", "end_with": "(?:{})$"}[plain].format(value))
        else:
            test = {"contain": text.contains, "begin_with": text.startswith, "end_with": text.endswith}[plain](F.lit(str(value)))
        return _unless(c, test) if op.startswith("not_") else test
    raise ValueError(f"unknown operator {op}")


def set_predicate(c: Column, x: ItemSet, kind: str = "string") -> Column:
    """A number column is compared with numbers, a text one with texts; values of the other kind match nothing."""
    if is_number_type(kind):
        values = []
        for v in x.values:
            try:
                values.append(float(v))
            except (TypeError, ValueError):
                continue
        values = [int(v) if v.is_integer() and kind not in FRACTIONAL else v for v in values]
    else:
        values = [str(v) for v in x.values if v is not None]
    text = c if kind == "string" or is_number_type(kind) else c.cast("string")
    test = text.isin(*values) if values else F.lit(False)
    return is_blank(c, kind) | test if x.blank else test


def date_predicate(c: Column, rule: DateFilter, kind: str = "timestamp") -> Column:
    """Today and its neighbours, this, last and next week, month, quarter and year, year to date, Q1-4, M1-12, null.

    A period is a half-open range in the column's own type, so that it reaches the scan.
    """
    name = rule.name
    if name == "null":
        return c.isNull()
    if re.fullmatch(r"Q[1-4]", name):
        return F.quarter(c.cast("date")) == int(name[1:])
    if re.fullmatch(r"M([1-9]|1[0-2])", name):
        return F.month(c.cast("date")) == int(name[1:])
    if rule.as_of is None:
        raise ValueError("this rule needs as_of")
    own, kind = (c, kind) if kind in ("date", "timestamp", "timestamp_ntz") else (c.try_cast("timestamp_ntz"), "timestamp_ntz")
    first, last = (F.lit(day).cast(kind) for day in period(name, rule.as_of))
    return (own >= first) & (own < last)


def period(name: str, now: date) -> tuple[date, date]:
    """[first, last) of a named period; weeks begin on Sunday."""
    days = {"yesterday": (-1, 0), "today": (0, 1), "tomorrow": (1, 2), "last_7_days": (-6, 1)}
    if name in days:
        a, b = days[name]
        return now + timedelta(a), now + timedelta(b)
    if name == "year_to_date":
        return date(now.year, 1, 1), now + timedelta(1)
    which, unit = name.split("_")
    shift = {"last": -1, "this": 0, "next": 1}[which]
    if unit == "week":
        start = now - timedelta((now.weekday() + 1) % 7) + timedelta(7 * shift)
        return start, start + timedelta(7)
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    at = (now.year * 12 + now.month - 1) // months + shift
    begin = lambda k: date(k * months // 12, k * months % 12 + 1, 1)
    return begin(at), begin(at + 1)


#: Accuracy of the approximate quantiles beside a rank: they miss it by at most one in so many rows.
ACCURACY = 10_000


def top_threshold(df: DataFrame, c: Column, n: int, low: bool, kind: str) -> Column:
    """The n-th best value, or the worst of fewer: a distributed partial top-n."""
    own = df.where(is_present(c, kind)).select(c.alias("v"))
    best = own.orderBy(F.col("v").asc() if low else F.col("v").desc()).limit(n)
    return best.agg((F.max if low else F.min)("v")).scalar()


def percent_threshold(df: DataFrame, c: Column, percent: float, low: bool, kind: str) -> Column:
    """The value of rank ceil(count * percent / 100).

    Two approximate quantiles close around the rank cut the values in three. Counts of rows tell in which part it lies,
    the middle one as a rule, and only the distinct values there are counted and ordered. The result does not depend on how
    good the quantiles are.
    """
    own = df.where(is_present(c, kind)).select(c.alias("v"))
    share = percent / 100 if low else 1 - percent / 100
    beside = [min(max(share + k * 2 / ACCURACY, 0.0), 1.0) for k in (-1, 1)]
    cuts = own.agg(F.percentile_approx("v", beside, ACCURACY)).scalar()
    cut = own.withColumn("cuts", cuts)
    first, last = F.col("cuts")[0], F.col("cuts")[1]
    below, above = F.count_if(F.col("v") < first), F.count_if(F.col("v") > last)
    sizes = cut.agg(F.count(F.lit(1)).alias("n"), below.alias("below"), above.alias("above"), F.max("cuts").alias("cuts"))
    sizes = sizes.withColumn("rank", F.ceil(F.col("n") * (percent / 100)))
    near, far = ("below", "above") if low else ("above", "below")
    part = F.when(F.col("rank") <= F.col(near), near).when(F.col("rank") <= F.col("n") - F.col(far), "middle").otherwise(far)
    before = F.when(part == near, 0).when(part == "middle", F.col(near)).otherwise(F.col("n") - F.col(far))
    at = sizes.where("rank > 0").select(F.struct(part.alias("part"), (F.col("rank") - before).alias("rest"), "cuts").alias("s")).agg(F.max("s")).scalar()
    place = F.when(F.col("v") < F.col("at.cuts")[0], "below").when(F.col("v") > F.col("at.cuts")[1], "above").otherwise("middle")
    inside = own.withColumn("at", at).where(place == F.col("at.part")).select("v").groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("rest", at.getField("rest"))
    run = F.sum("n").over(Window.orderBy(F.asc("v") if low else F.desc("v")).rowsBetween(Window.unboundedPreceding, -1))
    reached = inside.withColumn("before", F.coalesce(run, F.lit(0))).where("before < rest")
    return reached.agg((F.max if low else F.min)("v")).scalar()


def ranked_predicate(df: DataFrame, x: Item, name: str, kind: str) -> Column:
    """A rule about the whole column as a comparison with one value."""
    c, low = F.col(f"`{name}`"), x.op.startswith("bottom")
    present = F.when(~F.isnan(c), c) if kind in FRACTIONAL else c
    if x.op in DYNAMIC:
        mean = F.lit(x.value) if x.value is not None else df.agg(F.avg(present)).scalar()
        return (c > mean) & is_present(c, kind) if x.op == "above_average" else c < mean
    if x.op.endswith("percent_range"):
        span = (F.max(present) - F.min(present)) * (x.value / 100)
        edge = df.agg(F.min(present) + span if low else F.max(present) - span).scalar()
    elif x.op.endswith("percent"):
        edge = percent_threshold(df, c, x.value, low, kind)
    else:
        if math.floor(x.value) < 1:
            return F.lit(False)
        edge = top_threshold(df, c, math.floor(x.value), low, kind)
    return c <= edge if low else (c >= edge) & is_present(c, kind)


def compile_tree(df: DataFrame, tree, columns: list[str] | None = None) -> Column:
    """The predicate of a tree over df; columns names the range's fields in order."""
    names, types = columns or df.columns, dict(df.dtypes)

    def visit(x) -> Column:
        if isinstance(x, Node):
            parts = [visit(child) for child in x.children]
            if not parts:
                return F.lit(x.op == "and")
            out = parts[0]
            for p in parts[1:]:
                out = out & p if x.op == "and" else out | p
            return out
        name = names[x.field]
        c, kind = F.col(f"`{name}`"), types[name]
        if isinstance(x, ItemSet):
            return set_predicate(c, x, kind)
        if isinstance(x, DateFilter):
            return date_predicate(c, x, kind)
        if x.op in RANKED or x.op in DYNAMIC:
            return ranked_predicate(df, x, name, kind)
        return item_predicate(c, x, kind)

    return visit(tree)


def apply(df: DataFrame, tree, columns: list[str] | None = None) -> DataFrame:
    """The rows of df that pass."""
    return df.where(compile_tree(df, tree, columns))


def hidden_rows(df: DataFrame, tree, columns: list[str] | None = None, name: str = "hidden") -> DataFrame:
    """Adds whether the filter hides the row."""
    return df.withColumn(name, ~flag(compile_tree(df, tree, columns)))


_ODF = {"=": "equal", "!=": "not_equal", "<": "less", ">": "greater", "<=": "less_equal", ">=": "greater_equal", "empty": "empty", "!empty": "not_empty", "contains": "contain", "!contains": "not_contain", "begins-with": "begin_with", "!begins-with": "not_begin_with", "ends-with": "end_with", "!ends-with": "not_end_with", "top values": "top", "bottom values": "bottom", "top percent": "top_percent", "bottom percent": "bottom_percent", "match": "equal", "!match": "not_equal"}
_GNUMERIC = {"eq": "equal", "gt": "greater", "gte": "greater_equal", "lt": "less", "lte": "less_equal", "ne": "not_equal", "blanks": "empty", "noblanks": "not_empty"}
_XLSX = {"equal": "equal", "greaterThan": "greater", "greaterThanOrEqual": "greater_equal", "lessThan": "less", "lessThanOrEqual": "less_equal", "notEqual": "not_equal"}
_XLS_XML = {"Equals": "equal", "DoesNotEqual": "not_equal", "GreaterThan": "greater", "GreaterThanOrEqual": "greater_equal", "LessThan": "less", "LessThanOrEqual": "less_equal", "Blanks": "empty", "NonBlanks": "not_empty", "Top": "top", "Bottom": "bottom", "TopPercent": "top_percent", "BottomPercent": "bottom_percent"}
_GNUMERIC["nonblanks"] = "not_empty"
VOCABULARIES = {"own": {op: op for op in RANKED}, "odf": _ODF, "gnumeric": _GNUMERIC, "xlsx": _XLSX, "xls_xml": _XLS_XML}


def imported_item(vocabulary: str, field_: int, name: str, value: str | None = None) -> Item | None:
    """An item from a file's operator name and operand; a comparison with text is dropped (None), All is no filter."""
    if name == "All":
        return None
    op = VOCABULARIES[vocabulary][name]
    if op in COMPARISONS or op in RANKED:
        try:
            return Item(field_, op, float(value))
        except (TypeError, ValueError):
            return None
    if op in ("equal", "not_equal") and value is not None:
        new, text, regex = rewrite_wildcard(op, value)
        return Item(field_, new, text, regex or name.endswith("match"))
    return Item(field_, op, value)


_PERIODS = {"yearToDate": "year_to_date", "aboveAverage": "above_average", "belowAverage": "below_average"} | {f"{w}{u}": f"{w}_{u.lower()}" for w in ("this", "last", "next") for u in ("Week", "Month", "Quarter", "Year")}


def from_plain(plain: list, as_of: date | None = None):
    """A tree from the plain lists that file parsers give.

    ["and" | "or", [child, ...]], ["set", field, values, blank], ["date", field, name] and ["item", vocabulary, field, name,
    value]; what is no filter (All, a comparison with text) is dropped, and None is left if nothing remains.
    """
    kind = plain[0]
    if kind in ("and", "or"):
        children = tuple(x for x in (from_plain(p, as_of) for p in plain[1]) if x is not None)
        return children[0] if len(children) == 1 else Node(kind, children) if children else None
    if kind == "set":
        return ItemSet(plain[1], tuple(plain[2]), bool(plain[3]))
    if kind == "date":
        name = _PERIODS.get(plain[2], plain[2])
        return Item(plain[1], name) if name in DYNAMIC else DateFilter(plain[1], name, as_of)
    return imported_item(plain[1], plain[2], plain[3], plain[4])


def value_order(c_type: Column, num: Column, text: Column) -> list[Column]:
    """Sort key of filter values: empty, then numbers, then text."""
    rank = F.when(c_type == "empty", 0).when(c_type == "numeric", 1).otherwise(2)
    return [rank, num, text]
