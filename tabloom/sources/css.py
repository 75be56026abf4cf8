"""CSS rules: selectors with combinators and pseudo parts, and property values with colour functions read."""

from __future__ import annotations

import colorsys
import re


class CssError(ValueError):
    pass


def parse_value(text: str):
    """A colour function as (r, g, b, a), url(...) as its target, else the word."""
    m = re.fullmatch(r"(rgba?|hsla?)\(([^)]*)\)", text)
    if m:
        parts = [p.strip() for p in m[2].split(",")]
        alpha = float(parts[3]) if len(parts) > 3 else 1.0
        if m[1].startswith("rgb"):
            r, g, b = (round(float(p[:-1]) * 2.55) if p.endswith("%") else int(p) for p in parts[:3])
        else:
            h, s, li = float(parts[0]) / 360, float(parts[1].rstrip("%")) / 100, float(parts[2].rstrip("%")) / 100
            r, g, b = (round(c * 255) for c in colorsys.hls_to_rgb(h, li, s))
        return r, g, b, alpha
    m = re.fullmatch(r"url\(\s*['\"]?(.*?)['\"]?\s*\)", text)
    return m[1] if m else text


def parse_selector(text: str) -> list[tuple[str, str, str]]:
    """(combinator, simple selector, pseudo) from left to right; combinators: '', ' ', '>', '+'."""
    out, combinator = [], ""
    for token in re.findall(r"[>+]|[^\s>+]+", text):
        if token in ">+":
            combinator = token
            continue
        simple, _, pseudo = token.partition(":")
        out.append((combinator or (" " if out else ""), simple, pseudo.lstrip(":")))
        combinator = ""
    if not out or combinator:
        raise CssError(f"bad selector {text!r}")
    return out


def parse(text: str) -> list[dict]:
    """One entry per (selector, property), in order."""
    text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
    out, at = [], 0
    while at < len(text) and text[at:].strip():
        begin = text.find("{", at)
        if text[at:].lstrip().startswith("@"):
            end = text.find(";", at)
            if 0 <= end and (begin < 0 or end < begin):  # a statement such as @charset
                at = end + 1
                continue
            depth, end = 1, begin + 1
            while begin >= 0 and depth and end < len(text):
                depth, end = depth + (text[end] == "{") - (text[end] == "}"), end + 1
            if begin < 0 or depth:
                raise CssError("at-rule without an end")
            if "{" in text[begin + 1 : end - 1]:  # its rules hold under a condition
                out += [rule | {"at": text[at:begin].strip()} for rule in parse(text[begin + 1 : end - 1])]
            at = end
            continue
        end = text.find("}", begin)
        if begin < 0 or end < 0:
            raise CssError("rule without a body")
        body = re.findall(r"\s*([\w-]+)\s*:\s*((?:[^;()]|\([^)]*\))+);?", text[begin + 1 : end])
        for selector in text[at:begin].split(","):
            chain = parse_selector(selector.strip())
            for name, value in body:
                words = re.findall(r"[\w-]+\([^)]*\)|\"[^\"]*\"|[^\s,]+", value.strip())
                out.append({"selector": selector.strip(), "chain": chain, "property": name, "values": [parse_value(w) for w in words]})
        at = end + 1
    return out


def properties(rules: list[dict], selector: str) -> dict:
    """What a selector sets without a condition; later rules win."""
    chain = parse_selector(selector)
    return {r["property"]: r["values"] for r in rules if r["chain"] == chain and "at" not in r}
