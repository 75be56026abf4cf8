"""Spreadsheet formulas as native column expressions: operators, references and common functions of one row.

A reference is a column name in brackets, [price] or Sales[price], or an A1 address whose row is that of the first data
row, read relative to each row: with base row 2, B2 is the second column of the row at hand. Numbers in text count as
numbers; text that is none, a division by zero and the like give null, as an error cell does.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    pass


_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<text>"(?:[^"]|"")*")|(?P<field>[A-Za-z_][\w.]*\[[^\]]+\]|\[[^\]]+\])
    |(?P<function>[A-Za-z][A-Za-z0-9.]*)\(|(?P<cell>\$?[A-Za-z]{1,3}\$?\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|<>|[-+*/^&=<>(),:%]))""",
    re.X,
)
_BINARY = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 6}


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _text(c: Column) -> Column:
    n = _number(c)
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(whole & (F.typeof(c) != "string"), n.cast("long").cast("string")).otherwise(c.cast("string"))


def _half_up(c: Column, digits: Column) -> Column:
    scale = F.pow(F.lit(10.0), digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def _numbers(args: list[Column]) -> Column:
    return F.filter(F.array(*map(_number, args)), lambda x: x.isNotNull())


def _sum(args: list[Column]) -> Column:
    return F.aggregate(_numbers(args), F.lit(0.0), lambda a, x: a + x)


def _all_of(args: list[Column], both: bool) -> Column:
    out = args[0].try_cast("boolean")
    for a in args[1:]:
        out = out & a.try_cast("boolean") if both else out | a.try_cast("boolean")
    return out


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "IF": lambda a, b, c=None: F.when(a.try_cast("boolean"), b).otherwise(F.lit(False) if c is None else c),
    "IFERROR": lambda a, b: F.coalesce(a, b),
    "AND": lambda *a: _all_of(list(a), True),
    "OR": lambda *a: _all_of(list(a), False),
    "NOT": lambda a: ~a.try_cast("boolean"),
    "TRUE": lambda: F.lit(True),
    "FALSE": lambda: F.lit(False),
    "ABS": lambda a: F.abs(_number(a)),
    "INT": lambda a: F.floor(_number(a)).cast("double"),
    "SIGN": lambda a: F.signum(_number(a)),
    "SQRT": lambda a: F.when(_number(a) >= 0, F.sqrt(_number(a))),
    "EXP": lambda a: F.exp(_number(a)),
    "LN": lambda a: F.when(_number(a) > 0, F.ln(_number(a))),
    "POWER": lambda a, b: F.pow(_number(a), _number(b)),
    "MOD": lambda a, b: _number(a) - _number(b) * F.floor(F.try_divide(_number(a), _number(b))),
    "ROUND": lambda a, b=None: _half_up(_number(a), F.lit(0.0) if b is None else _number(b)),
    "SUM": lambda *a: _sum(list(a)),
    "AVERAGE": lambda *a: F.try_divide(_sum(list(a)), F.size(_numbers(list(a)))),
    "COUNT": lambda *a: F.size(_numbers(list(a))).cast("double"),
    "MIN": lambda *a: F.coalesce(F.array_min(_numbers(list(a))), F.lit(0.0)),
    "MAX": lambda *a: F.coalesce(F.array_max(_numbers(list(a))), F.lit(0.0)),
    "LEN": lambda a: F.length(_text(a)).cast("double"),
    "LEFT": lambda a, b=None: F.substring(_text(a), F.lit(1), F.lit(1) if b is None else _number(b).cast("int")),
    "RIGHT": lambda a, b=None: F.right(_text(a), F.lit(1) if b is None else _number(b).cast("int")),
    "MID": lambda a, b, c: F.substring(_text(a), _number(b).cast("int"), _number(c).cast("int")),
    "UPPER": lambda a: F.upper(_text(a)),
    "LOWER": lambda a: F.lower(_text(a)),
    "TRIM": lambda a: F.btrim(F.regexp_replace(_text(a), " +", " ")),
    "CONCATENATE": lambda *a: F.concat(*(F.coalesce(_text(x), F.lit("")) for x in a)),
    "FIND": lambda a, b: F.nullif(F.call_function("instr", _text(b), _text(a)), F.lit(0)).cast("double"),
    "SUBSTITUTE": lambda a, b, c: F.replace(_text(a), _text(b), _text(c)),
    "ISBLANK": lambda a: a.isNull() | (a.cast("string") == ""),
    "ISNUMBER": lambda a: _number(a).isNotNull(),
    "ISTEXT": lambda a: a.isNotNull() & _number(a).isNull(),
    "YEAR": lambda a: F.year(a.try_cast("date")).cast("double"),
    "MONTH": lambda a: F.month(a.try_cast("date")).cast("double"),
    "DAY": lambda a: F.dayofmonth(a.try_cast("date")).cast("double"),
}


class _Parser:
    def __init__(self, text: str, columns: list[str], base_row: int):
        self.columns, self.base_row, self.tokens, at = columns, base_row, [], 0
        text = text.strip().removeprefix("=").rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(f"unexpected {text[at:at + 10]!r} at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise FormulaError(f"expected {value or 'more'}, not {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def whole(self) -> Column:
        out = self.expression(0)
        if self.peek()[0] != "end":
            raise FormulaError(f"unexpected {self.peek()[1]!r}")
        return out

    def expression(self, level: int) -> Column:
        left = self.operand()
        while self.peek()[0] == "op" and _BINARY.get(self.peek()[1], -1) > level:
            op = self.take()[1]
            right = self.expression(_BINARY[op])
            left = self.binary(op, left, right)
        return left

    @staticmethod
    def binary(op: str, a: Column, b: Column) -> Column:
        if op == "&":
            return F.concat(F.coalesce(_text(a), F.lit("")), F.coalesce(_text(b), F.lit("")))
        if op in ("=", "<>"):
            numeric = _number(a).isNotNull() & _number(b).isNotNull()
            same = F.when(numeric, _number(a) == _number(b)).otherwise(F.lower(a.cast("string")) == F.lower(b.cast("string")))
            return same if op == "=" else ~same
        x, y = _number(a), _number(b)
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "^": lambda: F.pow(x, y), "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()

    def operand(self) -> Column:
        kind, value = self.take()
        if kind == "op" and value in "+-":
            inner = self.operand()
            out = -_number(inner) if value == "-" else inner
        elif kind == "number":
            out = F.lit(float(value))
        elif kind == "text":
            out = F.lit(value[1:-1].replace('""', '"'))
        elif kind == "field":
            out = self.column(value[value.index("[") + 1 : -1].lstrip("@"))
        elif kind == "cell":
            out = self.cells(value)
        elif kind == "name":
            if value.upper() in ("TRUE", "FALSE"):
                out = F.lit(value.upper() == "TRUE")
            else:
                out = self.column(value)
        elif kind == "function":
            out = self.call(value.upper())
        elif value == "(":
            out = self.expression(0)
            self.take(")")
        else:
            raise FormulaError(f"unexpected {value!r}")
        while self.peek() == ("op", "%"):
            self.take()
            out = _number(out) / 100
        return out

    def column(self, name: str) -> Column:
        if name not in self.columns:
            raise FormulaError(f"no column {name!r}")
        return F.col(f"`{name}`")

    def cells(self, address: str) -> Column:
        m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", address)
        at = 0
        for c in m[1].upper():
            at = at * 26 + ord(c) - 64
        if int(m[2]) != self.base_row:
            raise FormulaError(f"{address} is in another row")
        if at > len(self.columns):
            raise FormulaError(f"no column {m[1]}")
        return F.col(f"`{self.columns[at - 1]}`")

    def call(self, name: str) -> Column:
        if name not in FUNCTIONS:
            raise FormulaError(f"unknown function {name}")
        args: list[Column] = []
        while self.peek() != ("op", ")"):
            if args:
                self.take(",")
            if self.peek()[0] == "cell" and self.tokens[self.at + 1 : self.at + 2] == [("op", ":")]:
                args += self.span()
            else:
                args.append(self.expression(0))
        self.take(")")
        try:
            return FUNCTIONS[name](*args)
        except TypeError:
            raise FormulaError(f"{name} does not take {len(args)} arguments") from None

    def span(self) -> list[Column]:
        first = self.take()[1]
        self.take(":")
        last = self.take()[1]
        self.cells(first), self.cells(last)
        place = lambda a: sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(re.sub(r"[^A-Z]", "", a.upper()))))
        return [F.col(f"`{c}`") for c in self.columns[place(first) - 1 : place(last)]]


def formula(text: str, columns: list[str], base_row: int = 2) -> Column:
    """A formula over the columns of a range, in order."""
    return _Parser(text, columns, base_row).whole()
