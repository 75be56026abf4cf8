"""Format-preserving pseudonyms for personal numbers, dates and addresses (operator 3). DataFrame functions only.

One pattern finds the candidates of a text; the text between them stays as it is. A candidate that passes its kind's
test is taken apart into a number below a * b, permuted by an eight-round Feistel network with a keyed round
function (additions modulo a and b, so every permutation stays inside its format) and put back into the same format.
Equal values get equal pseudonyms in every document, different ones different ones. There is no shuffle and no state.

kind      test                                     what is permuted
card      13 to 19 digits that pass Luhn           all but the last digit, which is computed anew
date      a real day from 1900 to 2099; with        the day, among the 73,049 of that range; of month-first dates the
          slashes month-first if day-first fails    year and the day of the year, or the leap day, among their own
ssn       area, group and serial allowed           all three, within what is allowed
ip        four numbers up to 255                   all 32 bits
phone     6 to 12 digits after +country code, or   the digits after the country code, so a number has one pseudonym
          a 3-3-4 number                           with and without it
email     a mail address                           all letters (their case stays) and digits of the part before @, in
                                                   blocks whose permutation depends on the blocks before

The round function is HMAC-SHA-256. Its padded keys come from a one-row relation through scalar subqueries, so neither
they nor the key stand in a plan's text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identifier

ROUNDS = 8
Keys = tuple[Column, Column]
_EDGE, _STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_NUMBERS = "|".join(
    [
        rf"{_EDGE}\d{{4}}-\d\d-\d\d{_STOP}(?!-\d)",
        rf"{_EDGE}\d\d(?:/\d\d/|\.\d\d\.)\d{{4}}{_STOP}(?!\.\d)",
        rf"{_EDGE}\d{{3}}-\d\d-\d{{4}}{_STOP}(?!-\d)",
        rf"{_EDGE}(?<!\d\.)(?:\d{{1,3}}\.){{3}}\d{{1,3}}{_STOP}(?!\.\d)",
        rf"(?<![\p{{L}}\p{{N}}_+])\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}{_STOP}",
        rf"(?<![\p{{L}}\p{{N}}_+])\+(?!1[ .(-])\d{{1,3}}(?:[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})){{2,6}}{_STOP}",
        rf"(?<![\p{{L}}\p{{N}}_+])(?:\(\d{{3}}\) ?|\d{{3}}-)\d{{3}}-\d{{4}}{_STOP}(?!-\d)",
        rf"(?<![\p{{L}}\p{{N}}_+])(?<!\d[ .])(?:[2-9]\d\d\.[2-9]\d\d\.|[2-9]\d\d [2-9]\d\d )\d{{4}}{_STOP}(?![ .-]\d)",
        rf"{_EDGE}(?<!\d[-.])\d(?:[ -]?\d){{12,18}}{_STOP}(?!-\d)",
    ]
)
#: Most places are ruled out by their first character.
PATTERN = rf"{_MAIL}|(?=[0-9+(])(?:{_NUMBERS})"
#: A card number as it is usually written, to be found inside a longer run of digits.
_CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)"
_MONTH_DAYS = [f"{m:02}/{d:02}" for m, n in enumerate((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1) for d in range(13, n + 1)]
#: Characters of a mail address that one permutation takes: two halves of so many digits or letters fit a long.
_BLOCK = {10: 18, 26: 26}
_POWERS = {base: f"array({', '.join(f'{base**k}L' for k in range(n))})" for base, n in ((10, 19), (26, 14))}
_MONTH_DAY_TABLE = f"array({', '.join(map(repr, _MONTH_DAYS))})"


def _long(x: Column | int) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def _power(base: int, n: Column) -> Column:
    """base ** n as a long, from a table: pow() would round."""
    return F.element_at(F.expr(_POWERS[base]), n.cast("int") + 1)


def _split_digits(s: Column, size: Column) -> tuple[Column, ...]:
    half = F.floor(size / 2)
    left = F.coalesce(F.substring(s, F.lit(1), half).try_cast("long"), _long(0))
    return left, F.coalesce(F.substring(s, half + 1, size - half).try_cast("long"), _long(0)), _power(10, half), _power(10, size - half)


def _letters_number(s: Column) -> Column:
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), _long(0), lambda acc, c: acc * 26 + F.ascii(c) - 97)


def _number_letters(x: Column, size: Column) -> Column:
    places = F.when(size > 0, F.sequence(_long(1), size.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.array_join(F.transform(places, lambda i: F.chr(F.pmod(_int_div(x, _power(26, size - i)), _long(26)) + 97)), "")


def _with(value: Column, f) -> Column:
    """f of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _int_div(x: Column, y: Column) -> Column:
    """Exact integer quotient of non-negative longs."""
    return F.call_function("div", x, y)


def _feistel(left: Column, right: Column, a: Column, b: Column, keys: Keys, tag: Column) -> Column:
    def step(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        known = F.when(even, state["r"]).otherwise(state["l"])
        message = F.concat_ws("|", tag, i.cast("string"), known.cast("string")).cast("binary")
        digest = F.sha2(F.concat(keys[1], F.unhex(F.sha2(F.concat(keys[0], message), 256))), 256)
        value = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        left = F.when(even, F.pmod(state["l"] + F.pmod(value, a), a)).otherwise(state["l"])
        right = F.when(even, state["r"]).otherwise(F.pmod(state["r"] + F.pmod(value, b), b))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")), step)


def _permuted_text(s: Column, base: int, keys: Keys, label: str) -> Column:
    """Digits (base 10) or small letters (base 26) of any number, permuted block by block."""
    size = _BLOCK[base]

    def block(i: Column) -> Column:
        def halves(x: Column) -> Column:
            n, half = F.length(x["s"]), F.floor(F.length(x["s"]) / 2)
            left, right = F.substring(x["s"], F.lit(1), half), F.substring(x["s"], half + 1, n)
            number = _letters_number if base == 26 else lambda t: F.coalesce(t.try_cast("long"), _long(0))
            permuted = _feistel(number(left), number(right), _power(base, half), _power(base, n - half), keys, x["tag"])

            def text(y: Column) -> Column:
                if base == 26:
                    return F.concat(_number_letters(y["l"], half), _number_letters(y["r"], n - half))
                return F.concat(F.when(half > 0, _pad(y["l"], half)).otherwise(""), _pad(y["r"], n - half))

            return _with(permuted, text)

        own = F.substring(s, i * size + 1, F.lit(size))
        tag = F.concat_ws(":", F.lit(label), F.length(s).cast("string"), i.cast("string"), F.substring(s, F.lit(1), i * size))
        return _with(F.struct(own.alias("s"), tag.alias("tag")), halves)

    last = F.floor((F.length(s) - 1) / size).cast("int")
    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")).otherwise("")


def _luhn(payload: Column) -> Column:
    """The check digit of a run of digits."""
    n = F.length(payload)

    def add(acc: Column, i: Column) -> Column:
        digit = F.substring(payload, i, F.lit(1)).cast("int")
        double = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return acc + F.when((n - i) % 2 == 0, double).otherwise(digit)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def _fill(form: Column, digits: Column, letters: Column | None = None) -> Column:
    """form with its n-th digit (letter) replaced by the n-th of digits (letters)."""

    def one(i: Column) -> Column:
        c, to = F.substring(form, i, F.lit(1)), F.substring(form, F.lit(1), i)
        out = F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(F.regexp_replace(to, "[^0-9]", "")), F.lit(1)))
        if letters is not None:
            nth = F.length(F.regexp_replace(to, "[^A-Za-z]", ""))
            new = F.substring(letters, nth, F.lit(1))
            out = out.when(c.rlike("^[a-z]$"), new).when(c.rlike("^[A-Z]$"), F.upper(new))
        return out.otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _pad(x: Column, size: Column | int) -> Column:
    return F.lpad(x.cast("string"), size if isinstance(size, int) else size.cast("int"), "0")


_FIRST_DAY = -25567  # 1900-01-01 as days since 1970-01-01
_DAYS_A, _DAYS_B = 319, 229  # 319 * 229 days are 1900 to 2099


def _passes(number: Column) -> Column:
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.length(digits).between(13, 19) & (_luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, F.length(digits), F.lit(1)).cast("int"))


def _kinds(matches: Column) -> Column:
    """kind, m, digits, before and after of each candidate; m is what a card's run holds of a valid number."""

    def kind_of(m: Column) -> Column:
        kind = (
            F.when(m.contains("@"), "email")
            .when(m.rlike(r"^\d{4}-\d\d-\d\d$"), "date")
            .when(m.rlike(r"^\d\d[/.]\d\d[/.]\d{4}$"), "date")
            .when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
            .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
            .when(m.rlike(r"^\+") | (F.length(F.regexp_replace(m, "[^0-9]", "")) == 10), "phone")
            .otherwise("card")
        )
        return F.struct(m.alias("m"), kind.alias("kind"), F.when(kind == "card", F.regexp_extract(m, _CARD, 0)).otherwise("").alias("inner"))

    def core(x: Column) -> Column:
        m, inner = x["m"], x["inner"]
        found = F.when(x["kind"] != "card", m).when((inner != "") & _passes(inner), inner).otherwise(m)

        def parts(y: Column) -> Column:
            at, own = F.instr(m, y), F.when(x["kind"] == "email", F.substring_index(y, "@", 1)).otherwise(y)
            return F.struct(
                y.alias("m"), F.regexp_replace(own, "[^0-9]", "").alias("digits"), x["kind"].alias("kind"),
                F.substring(m, F.lit(1), at - 1).alias("before"), F.substring(m, at + F.length(y), F.length(m)).alias("after"),
            )

        return _with(found, parts)

    return F.transform(F.transform(matches, kind_of), core)


def _country(m: Column, digits: Column) -> Column:
    """How many digits of a phone number are the country code."""
    said = F.length(F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1))
    return F.when(~m.startswith("+"), 0).when(said > 0, said).otherwise(F.greatest(F.lit(1), F.least(F.lit(3), F.length(digits) - 10)))


def _numbers(found: Column) -> Column:
    """Adds ok, the form of date or the size, and the numbers (l, r) below (a, b)."""

    def one(x: Column) -> Column:
        m, digits, kind = x["m"], x["digits"], x["kind"]
        iso = F.when(m.contains("-"), m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
        day = F.unix_date(iso.try_cast("date")) - _FIRST_DAY
        day_ok = F.coalesce((day >= 0) & (day < _DAYS_A * _DAYS_B), F.lit(False))
        year = F.substring(m, 7, 4).try_cast("long") - 1900
        month_day = F.array_position(F.expr(_MONTH_DAY_TABLE), F.substring(m, 1, 5)).cast("long") - 1
        slashed = m.contains("/") & year.between(0, 199)
        leap = _int_div(year - 4, _long(4))
        octets = F.split(m, r"\.")
        octet = lambda i: F.element_at(octets, i).try_cast("long")
        area, group, serial = (F.substring(digits, *at).try_cast("long") for at in ((1, 3), (4, 2), (6, 4)))
        ssn_ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        area = area - F.when(area > 666, 2).otherwise(1)
        payload = F.length(digits) - 1
        code = _country(m, digits)
        national = F.substring(digits, code + 1, F.length(digits))
        date = F.when(day_ok, "day").when(slashed & (month_day >= 0), "month").when(slashed & m.startswith("02/29") & (year > 0) & (year % 4 == 0), "leap")
        kinds = {
            "email": (F.lit(True), F.lit(0), F.lit(0), F.lit(1), F.lit(1)),
            "day": (F.lit(True), _int_div(day.cast("long"), _long(_DAYS_B)), F.pmod(day.cast("long"), _long(_DAYS_B)), F.lit(_DAYS_A), F.lit(_DAYS_B)),
            "month": (F.lit(True), year, month_day, F.lit(200), F.lit(len(_MONTH_DAYS))),
            "leap": (F.lit(True), _int_div(leap, _long(7)), F.pmod(leap, _long(7)), F.lit(7), F.lit(7)),
            "ssn": (ssn_ok, area, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999)),
            "ip": (F.greatest(*(octet(i) for i in range(1, 5))) < 256, octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536)),
            "phone": (F.length(national).between(6, 12), *_split_digits(national, F.length(national))),
            "card": (_passes(m), *_split_digits(digits, payload)),
        }
        form = F.when(kind == "date", F.coalesce(date, F.lit("no date"))).otherwise(kind)

        def numbers(y: Column) -> Column:
            none = F.struct(F.lit(False).alias("ok"), *(_long(0).alias(c) for c in "lrab"))
            out = F.when(y == "no date", none)
            for name, (ok, *values) in kinds.items():
                out = out.when(y == name, F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), *(F.coalesce(v.cast("long"), _long(0)).alias(c) for v, c in zip(values, "lrab"))))
            return F.struct(m.alias("m"), digits.alias("digits"), y.alias("form"), x["before"].alias("before"), x["after"].alias("after"), code.alias("code"), out.alias("v"))

        return _with(form, numbers)

    return F.transform(found, one)


def _written(numbers: Column, keys: Keys) -> Column:
    def one(x: Column) -> Column:
        m, digits, form, v = x["m"], x["digits"], x["form"], x["v"]
        size = F.when(form == "phone", F.length(digits) - x["code"]).when(form == "card", F.length(digits)).otherwise(0)
        tag = F.concat_ws(":", form, size.cast("string"))

        def numeric(p: Column) -> Column:
            left, right = p["l"], p["r"]
            day = F.date_from_unix_date((left * _DAYS_B + right + _FIRST_DAY).cast("int"))
            dated = F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
            month = F.concat_ws("/", F.element_at(F.expr(_MONTH_DAY_TABLE), (right + 1).cast("int")), (left + 1900).cast("string"))
            leap = F.concat(F.lit("02/29/"), (1904 + 4 * (left * 7 + right)).cast("string"))
            area = left + F.when(left >= 665, 2).otherwise(1)
            ssn = F.concat_ws("-", _pad(area, 3), _pad(_int_div(right, _long(9999)) + 1, 2), _pad(F.pmod(right, _long(9999)) + 1, 4))
            ip = F.concat_ws(".", *(y.cast("string") for y in (_int_div(left, _long(256)), F.pmod(left, _long(256)), _int_div(right, _long(256)), F.pmod(right, _long(256)))))
            half = F.floor(size / 2)
            phone = _fill(m, F.concat(F.substring(digits, F.lit(1), x["code"]), _pad(left, half), _pad(right, size - half)))
            half2 = F.floor((size - 1) / 2)
            card = _with(F.concat(_pad(left, half2), _pad(right, size - 1 - half2)), lambda payload: _fill(m, F.concat(payload, _luhn(payload).cast("string"))))
            return F.when(form == "day", dated).when(form == "month", month).when(form == "leap", leap).when(form == "ssn", ssn).when(form == "ip", ip).when(form == "phone", phone).otherwise(card)

        local = F.substring_index(m, "@", 1)
        letters = F.lower(F.regexp_replace(local, "[^A-Za-z]", ""))
        mail = F.struct(_permuted_text(digits, 10, keys, "mail digits").alias("d"), _permuted_text(letters, 26, keys, "mail letters").alias("w"))
        email = F.concat(_with(mail, lambda y: _fill(local, y["d"], y["w"])), F.lit("@"), F.substring_index(m, "@", -1))
        other = _with(_feistel(v["l"], v["r"], v["a"], v["b"], keys, tag), numeric)
        return F.concat(x["before"], F.when(~v["ok"], m).when(form == "email", email).otherwise(other), x["after"])

    return F.transform(numbers, one)


def _pads(spark: SparkSession, key: str) -> DataFrame:
    """The inner and outer key blocks of HMAC-SHA-256, as a one-row relation."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    blocks = {name: bytes(c ^ pad for c in secret).hex() for name, pad in (("i", 0x36), ("o", 0x5C))}
    return spark.sql("SELECT unhex(i) AS i, unhex(o) AS o FROM VALUES (:i, :o) AS t(i, o)", args=blocks)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_found, n_replaced; one row per input row.

    text is the whole text with every validated value replaced by its pseudonym; a candidate that fails its test stays.
    A null text stays null with zero counts, an empty one stays empty; a null doc_id stays null. Rows are independent:
    repeated rows give equal results. An empty table gives an empty result; other columns play no part.
    """
    pattern = F.lit(PATTERN)
    pads = _pads(docs.sparkSession, key)
    slim = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"))
    none = F.array().cast("array<string>")
    found = slim.withColumn("_matches", F.when(F.col("text").rlike(PATTERN), F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none))
    keyed = found.withColumns({"_i": pads.select("i").scalar(), "_o": pads.select("o").scalar()})
    steps = keyed.withColumn("_numbers", _numbers(_kinds(F.col("_matches"))))
    written = steps.withColumn("_new", F.when(F.size("_matches") > 0, _written(F.col("_numbers"), (F.col("_i"), F.col("_o")))).otherwise(none))
    between = F.split("text", PATTERN, -1)
    text = F.array_join(F.zip_with(between, F.col("_new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = F.when(F.size("_matches") > 0, text).otherwise(F.col("text"))
    return written.select("doc_id", out.alias("text"), F.size("_matches").alias("n_found"), F.size(F.filter("_numbers", lambda x: x["v"]["ok"])).alias("n_replaced"))
