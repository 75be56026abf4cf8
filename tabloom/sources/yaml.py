"""YAML: documents, block and flow sequences and maps, literal and folded blocks, scalars over several lines, anchors.

Plain scalars are typed. Tags, merge keys and complex keys are not supported and raise YamlError, as does anything that
is left over; nothing is lost silently.
"""

from __future__ import annotations

import re

_TRUE, _FALSE = {"y", "yes", "true", "on"}, {"n", "no", "false", "off"}
_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


class YamlError(ValueError):
    pass


_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_NAMED = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0"}


def _unescape(m: re.Match) -> str:
    code = m[1]
    if code[0] in "xuU" and len(code) > 1:
        return chr(int(code[1:], 16))
    if code not in _NAMED:
        raise YamlError(f"unknown escape \\{code}")
    return _NAMED[code]


def scalar(text: str):
    """Number, then keyword, else text."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return _ESCAPE.sub(_unescape, text[1:-1])
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if _NUMBER.fullmatch(text):
        return float(text)
    low = text.lower()
    if low in _TRUE:
        return True
    if low in _FALSE:
        return False
    if low in ("null", "~", ""):
        return None
    return text


def _flow(text: str):
    at = 0

    def skip():
        nonlocal at
        while at < len(text) and text[at] in " \t\n":
            at += 1

    def value():
        nonlocal at
        skip()
        if text[at] in "[{":
            close, out = ("]", []) if text[at] == "[" else ("}", {})
            at += 1
            while True:
                skip()
                if at >= len(text):
                    raise YamlError("flow collection without an end")
                if text[at] == close:
                    at += 1
                    return out
                item = value()
                skip()
                if isinstance(out, dict):
                    if text[at] != ":":
                        raise YamlError("a key needs a colon")
                    at += 1
                    out[item] = value()
                    skip()
                else:
                    out.append(item)
                if at < len(text) and text[at] == ",":
                    at += 1
        start = at
        if text[at] in "\"'":
            end = text.find(text[at], at + 1)
            if end < 0:
                raise YamlError("quoted scalar without an end")
            at = end + 1
        else:
            while at < len(text) and text[at] not in ",]}" and not (text[at] == ":" and text[at + 1 : at + 2] in " "):
                at += 1
        return scalar(text[start:at])

    return value()


def _strip_comment(line: str) -> str:
    out, quote = [], None
    for k, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'" and (not out or out[-1] in " :[{,-"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] in " \t"):
            break
        out.append(c)
    return "".join(out).rstrip()


class _Parser:
    def __init__(self, lines: list[str]):
        self.lines, self.at, self.anchors = lines, 0, {}

    def document(self):
        out = self.block(0)
        if self.peek() is not None:
            raise YamlError(f"unexpected line: {self.peek()[1]}")
        return out

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.lines):
            line = _strip_comment(self.lines[self.at])
            if line.strip():
                if line.lstrip(" ").startswith("\t"):
                    raise YamlError("a tab indents a line")
                return len(line) - len(line.lstrip(" ")), line.strip()
            self.at += 1
        return None

    def block(self, indent: int):
        head = self.peek()
        if head is None or head[0] < indent:
            return None
        depth, text = head
        if text == "-" or text.startswith("- "):
            return self.sequence(depth)
        if _key(text):
            return self.mapping(depth)
        self.at += 1
        return self.inline(text, depth - 1)

    def inline(self, text: str, depth: int):
        """A value that begins on a line of a block at depth; what is indented further belongs to it."""
        if m := re.match(r"&(\S+)(?:\s+(.*))?$", text, re.S):
            value = self.inline(m[2], depth) if m[2] else self.block(depth + 1)
            self.anchors[m[1]] = value
            return value
        if m := re.fullmatch(r"\*(\S+)", text):
            if m[1] not in self.anchors:
                raise YamlError(f"unknown anchor {m[1]}")
            return self.anchors[m[1]]
        if text[:1] in ("!", "@", "`", "%") or text.startswith("? "):
            raise YamlError(f"not supported: {text}")
        if text[:1] in ("|", ">"):
            return self.literal(text, depth)
        if text[:1] in ("[", "{"):
            while _open(text) and self.at < len(self.lines):
                text += " " + _strip_comment(self.lines[self.at]).strip()
                self.at += 1
            return _flow(text)
        quote = text[:1] if text[:1] in ("'", '"') else None
        ended = (lambda t: re.fullmatch(r"'(?:[^']|'')*'" if quote == "'" else r'"(?:[^"\\]|\\.)*"', t, re.S)) if quote else (lambda t: False)
        blank = 0
        while self.at < len(self.lines) and not ended(text):
            raw = self.lines[self.at]
            line = raw.rstrip() if quote else _strip_comment(raw)
            if not line.strip():
                if not raw.strip():
                    blank += 1
                self.at += 1
                continue
            if len(line) - len(line.lstrip(" ")) <= depth:
                break
            if not quote and _key(line.strip()):
                raise YamlError(f"a key inside a scalar: {line.strip()}")
            text += ("\n" * blank or " ") + line.strip()
            blank = 0
            self.at += 1
        if quote and not ended(text):
            raise YamlError(f"quoted scalar without an end: {text}")
        return scalar(text)

    def literal(self, mark: str, depth: int) -> str:
        out, base = [], None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            own = len(line) - len(line.lstrip(" "))
            if line.strip() and own <= depth:
                break
            base = own if base is None and line.strip() else base
            out.append(line[base or 0 :].rstrip("\n"))
            self.at += 1
        tail = 0
        while out and not out[-1].strip():
            out.pop()
            tail += 1
        body = "\n".join(out) if mark[0] == "|" else _fold(out)
        return body + ("" if "-" in mark or not out else "\n" * (1 + tail) if "+" in mark else "\n")

    def sequence(self, depth: int) -> list:
        out = []
        while (head := self.peek()) and head[0] == depth and (head[1] == "-" or head[1].startswith("- ")):
            rest = head[1][1:]
            body = rest.strip()
            if not body:
                self.at += 1
                out.append(self.block(depth + 1))
            elif _key(body) or body.startswith("- "):
                shift = depth + 1 + len(rest) - len(rest.lstrip(" "))
                self.lines[self.at] = " " * shift + body
                out.append(self.block(shift))
            else:
                self.at += 1
                out.append(self.inline(body, depth))
        return out

    def mapping(self, depth: int) -> dict:
        out = {}
        while (head := self.peek()) and head[0] == depth and (k := _key(head[1])):
            key, rest = k
            self.at += 1
            if rest:
                value = self.inline(rest, depth)
            else:
                nxt = self.peek()
                same = nxt is not None and nxt[0] == depth and nxt[1].startswith("-")
                value = self.block(depth if same else depth + 1)
            if key == "<<":
                raise YamlError("merge keys are not supported")
            out[key] = value
        return out


def _open(text: str) -> bool:
    plain = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"\\\\]|\\\\.)*\"", "", text)
    return plain.count("[") + plain.count("{") > plain.count("]") + plain.count("}")


def _fold(lines: list[str]) -> str:
    """Lines joined by blanks; empty lines are line breaks, and further indented ones keep theirs."""
    out, breaks = "", 0
    for k, line in enumerate(lines):
        if not line.strip():
            breaks += 1
            continue
        if k and out:
            kept = line.startswith(" ") or lines[k - 1 - breaks].startswith(" ")
            out += "\n" * (breaks + kept) if breaks or kept else " "
        else:
            out += "\n" * breaks
        out, breaks = out + line, 0
    return out


def _key(text: str) -> tuple[object, str] | None:
    m = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{}#&*!|>'"%@`][^#]*?)\s*:(?:\s+(.*))?$""", text)
    return (scalar(m[1]), (m[2] or "").strip()) if m else None


def parse(text: str) -> list:
    """The documents of a stream."""
    out, lines = [], []
    for line in text.removeprefix("﻿").splitlines():
        if line.startswith("%"):
            continue
        if line.startswith("---") or line.startswith("..."):
            if any(x.strip() for x in lines):
                out.append(_Parser(lines).document())
            lines = [line[3:]] if line[3:].strip() else []
        else:
            lines.append(line)
    if any(x.strip() for x in lines):
        out.append(_Parser(lines).document())
    return out
