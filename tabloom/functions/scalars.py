"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
#: Inches in one of each unit; an xlsx digit is 1.9 mm.
UNITS = {"in": 1.0, "pt": 1 / 72, "twip": 1 / 1440, "cm": 1 / 2.54, "mm": 1 / 25.4, "xlsx_digit": 1.9 / 25.4}
COLOURS = {"black": "000000", "white": "ffffff", "red": "ff0000", "lime": "00ff00", "blue": "0000ff", "green": "008000", "yellow": "ffff00", "cyan": "00ffff", "magenta": "ff00ff", "gray": "808080", "silver": "c0c0c0", "maroon": "800000", "olive": "808000", "purple": "800080", "teal": "008080", "navy": "000080", "orange": "ffa500"}
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A!")


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n"))


def parse_prefix_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _PREFIX, 1), F.lit("")).try_cast("double")


def to_long(c: Column) -> Column:
    """Integer prefix, saturating."""
    digits = F.nullif(F.regexp_extract(c, r"^([+-]?[0-9]+)", 1), F.lit(""))
    bound = F.when(digits.startswith("-"), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
    return F.when(digits.isNotNull(), F.coalesce(digits.try_cast("long"), bound))


def to_bool(c: Column) -> Column:
    return F.when(F.length(c) == 1, c != "0").otherwise(c.isin("true", "TRUE"))


def convert(c: Column, source: str, target: str) -> Column:
    if source not in UNITS or target not in UNITS:
        raise ValueError(f"no conversion from {source} to {target}")
    return c * F.lit(UNITS[source] / UNITS[target])


def to_length(c: Column) -> Column:
    """struct<unit, value> of texts such as 1.5cm."""
    return F.struct(F.nullif(F.regexp_extract(c, r"(cm|mm|in|pt|twip|px)\s*$", 1), F.lit("")).alias("unit"), parse_prefix_number(c).alias("value"))


def to_date_time(c: Column) -> Column:
    """ISO text to a timestamp without zone; a time alone is null."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d"), c.try_cast("timestamp_ntz"))


def date_serial(c: Column, origin: str = "1899-12-30") -> Column:
    """Days since the origin, with the part of the day."""
    second = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.datediff(c.cast("date"), F.lit(origin).cast("date")) + second / 86400


def serial_date(c: Column, origin: str = "1899-12-30") -> Column:
    micros = F.round(c * 86_400_000_000.0).cast("long")
    return F.lit(origin).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros / F.lit(1_000_000))


def number_text(c: Column) -> Column:
    """Shortest text that reads back as the number; whole numbers without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def colour(c: Column) -> Column:
    """struct<a, r, g, b> of RRGGBB, AARRGGBB (with or without #) or a name."""
    names = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    code = F.coalesce(names[F.lower(c)], F.regexp_replace(c, "^#", ""))
    full = F.when(code.rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("ff"), code)).when(code.rlike("^[0-9A-Fa-f]{8}$"), code)
    return F.struct(*(F.conv(F.substring(full, k, 2), 16, 10).cast("int").alias(n) for n, k in (("a", 1), ("r", 3), ("g", 5), ("b", 7))))


def error_code(c: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, ERRORS)), F.upper(c)), F.lit(0))


def enum_code(c: Column, names: list[str]) -> Column:
    """Place of a name in an enumeration, from 0; unknown names are null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)) - 1


def column_letters(c: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA; up to three letters."""
    n = c.cast("int")
    letter = lambda x: F.chr(x + 65)
    one, two = letter(n), F.concat(letter(F.floor(n / 26) - 1), letter(n % 26))
    m = n - 702
    three = F.concat(letter(F.floor(m / 676)), letter(F.floor(m / 26) % 26), letter(m % 26))
    return F.when(n < 26, one).when(n < 702, two).otherwise(three)


def letters_column(c: Column) -> Column:
    return F.aggregate(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64) - 1


def a1_address(c: Column) -> Column:
    """struct<row, col> from 0 of an A1 address."""
    col, row = F.regexp_extract(c, r"^\$?([A-Za-z]{1,3})\$?(\d+)$", 1), F.regexp_extract(c, r"^\$?([A-Za-z]{1,3})\$?(\d+)$", 2)
    return F.when(col != "", F.struct((row.cast("int") - 1).alias("row"), letters_column(col).alias("col")))


def r1c1_address(c: Column) -> Column:
    row, col = F.regexp_extract(c, r"^R(\d+)C(\d+)$", 1), F.regexp_extract(c, r"^R(\d+)C(\d+)$", 2)
    return F.when(row != "", F.struct((row.cast("int") - 1).alias("row"), (col.cast("int") - 1).alias("col")))


def odf_address(c: Column) -> Column:
    """struct<sheet, row, col> of an address such as $'My sheet'.$C$7 or .C7."""
    form = r"^\$?(?:'([^']*)'|([^'.$]*))\.\$?([A-Za-z]{1,3})\$?(\d+)$"
    part = lambda k: F.regexp_extract(c, form, k)
    sheet = F.nullif(F.concat(part(1), part(2)), F.lit(""))
    return F.when(part(4) != "", F.struct(sheet.alias("sheet"), (part(4).cast("int") - 1).alias("row"), letters_column(part(3)).alias("col")))


def locate(text: Column, offset: Column) -> Column:
    """struct<line, column> from 1 of a character offset, for messages about errors in a text."""
    before = F.substring(text, F.lit(1), offset)
    return F.struct(
        (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line"),
        (F.length(F.substring_index(before, "\n", -1)) + 1).cast("int").alias("column"),
    )


def uuid4() -> Column:
    """A random identifier of version 4."""
    return F.expr("uuid()")


def clamp_range(first: Column, last: Column, limit: int) -> tuple[Column, Column]:
    low, high = F.lit(0), F.lit(limit - 1)
    return F.least(F.greatest(first, low), high), F.least(F.greatest(last, low), high)


def is_valid_range(first_row: Column, first_col: Column, last_row: Column, last_col: Column) -> Column:
    return (first_row >= 0) & (first_col >= 0) & (first_row <= last_row) & (first_col <= last_col)


def xml_escape(c: Column, attribute: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"), ("'", "&apos;")) if attribute else ()):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_escape(c: Column) -> Column:
    """The inside of a JSON string literal."""
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(3), F.length(quoted) - 4)


def unquote(c: Column) -> Column:
    """A single- or double-quoted literal with its escapes read."""
    body = F.substring(c, F.lit(2), F.length(c) - 2)
    safe = F.when(c.startswith("'"), F.replace(F.replace(body, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))).otherwise(body)
    return F.get_json_object(F.concat(F.lit('{"v":"'), safe, F.lit('"}')), "$.v")


def is_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[ \t\r\n]*$"), F.lit(True))


def is_xml_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_:\x{C0}-\x{10FFFF}][A-Za-z0-9_:.\-\x{B7}\x{C0}-\x{10FFFF}]*$")
