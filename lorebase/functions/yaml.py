"""Block lists of texts: a reader of YAML's core schema for small documents, and Arrow columns of what it finds.

Read are nested block mappings and sequences, flow collections over several lines, plain, quoted and block scalars,
comments and a leading `---`. Plain scalars are null, booleans, numbers or text as in the core schema, so a date is text.
Malformed are tabs as indentation, repeated keys, anchors, aliases, tags, several documents, a plain scalar with `: `
in it, and collections nested more than DEPTH deep.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 64
_KEY = re.compile(r"""(?P<quoted>"(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*')[ \t]*:(?=[ \t\n]|\Z)|(?P<plain>(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?)[ \t]*:(?=[ \t\n]|\Z)""")
_HEADER = re.compile(r"([|>])(?:([+-])?([1-9])?|([1-9])([+-])?)[ \t]*(?:[ \t]#.*)?$")
_INT, _FLOAT = re.compile(r"[-+]?\d+$"), re.compile(r"[-+]?(\.\d+|\d+(\.\d*)?)([eE][-+]?\d+)?$")
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_WIDTHS = {"x": 2, "u": 4, "U": 8}
_INDICATORS = set(",[]{}#&*!|>'\"%@`")


class YamlError(ValueError):
    """The text is no such document."""


def plain_value(text: str) -> Any:
    """A plain scalar by the core schema."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text[0] in "tT"
    if _INT.match(text):
        return int(text) if len(text) < 4000 else text
    if re.match(r"0o[0-7]+$|0x[0-9a-fA-F]+$", text):
        return int(text[2:], 8 if text[1] == "o" else 16)
    if _FLOAT.match(text):
        return float(text)
    if re.match(r"[-+]?\.(inf|Inf|INF)$", text):
        return -math.inf if text[0] == "-" else math.inf
    return math.nan if text in (".nan", ".NaN", ".NAN") else text


class Reader:
    """One document: `at` is the number of the line that is read next, indents hold -1 for blank and comment lines."""

    def __init__(self, text: str):
        self.text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        self.starts = [0] + [m.end() for m in re.finditer("\n", self.text)]
        self.at = 0
        self.inline: tuple[int, int] | None = None  # (place, indent) of what follows `- ` on the line that is read

    def line(self, n: int) -> str:
        end = self.starts[n + 1] - 1 if n + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[n] : end]

    def peek(self) -> tuple[int, int] | None:
        """(place, indent) of the next content, past blank and comment lines."""
        if self.inline:
            return self.inline
        while self.at < len(self.starts):
            line = self.line(self.at)
            body = line.lstrip(" ")
            if body.strip() and body[0] != "#":
                if body[0] == "\t":
                    raise YamlError("a tab as indentation")
                return self.starts[self.at] + len(line) - len(body), len(line) - len(body)
            self.at += 1
        return None

    def rest(self, place: int) -> str:
        end = self.text.find("\n", place)
        return self.text[place : end if end >= 0 else len(self.text)]

    def document(self) -> Any:
        first = self.peek()
        if first and re.match(r"---(?:\s|$)", self.rest(first[0])):
            place = first[0] + 3
            body = self.rest(place).strip()
            self.at, self.inline = (self.at + 1, None) if not body or body[0] == "#" else (self.at, (place + len(self.rest(place)) - len(self.rest(place).lstrip()), 4))
        value = self.block(0, 0)
        last = self.peek()
        if last and self.rest(last[0]).rstrip() != "...":
            raise YamlError("content after the document")
        return value

    def block(self, least: int, depth: int) -> Any:
        """The node whose lines are indented by `least` at least; None if there is none."""
        if depth > DEPTH:
            raise YamlError("nested too deep")
        here = self.peek()
        if here is None or here[1] < least:
            return None
        place, indent = here
        rest = self.rest(place)
        if rest == "-" or rest.startswith(("- ", "-\t")):
            return self.sequence(indent, depth)
        if _KEY.match(self.text, place):
            return self.mapping(indent, depth)
        return self.scalar(place, least - 1, depth)

    def sequence(self, indent: int, depth: int) -> list:
        out = []
        while (here := self.peek()) and here[1] == indent:
            place, rest = here[0], self.rest(here[0])
            if not (rest == "-" or rest.startswith(("- ", "-\t"))):
                break
            body = rest[1:].lstrip(" \t")
            if not body or body[0] == "#":
                self.at, self.inline = self.at + 1, None
            else:
                inner = len(rest) - len(body)
                self.inline = place + inner, indent + inner
            out.append(self.block(indent + 1, depth + 1))
        self.closed(indent)
        return out

    def mapping(self, indent: int, depth: int) -> dict:
        out: dict = {}
        while (here := self.peek()) and here[1] == indent:
            m = _KEY.match(self.text, here[0])
            if not m:
                break
            key = m["plain"] if m["quoted"] is None else self.flow(here[0], depth)[0]
            key = key.strip()
            if key in out:
                raise YamlError(f"{key} twice")
            body = self.rest(m.end())
            place = m.end() + len(body) - len(body.lstrip(" \t"))
            self.inline = None
            if self.rest(place).strip() and self.rest(place)[0] != "#":
                out[key] = self.scalar(place, indent, depth + 1)
                continue
            self.at += 1
            then = self.peek()
            same = then is not None and then[1] == indent and re.match(r"-(?:\s|$)", self.rest(then[0]))
            out[key] = self.block(indent if same else indent + 1, depth + 1)
        self.closed(indent)
        return out

    def closed(self, indent: int) -> None:
        """After a collection comes something that is indented less."""
        then = self.peek()
        if then and then[1] > indent:
            raise YamlError("indentation that fits nothing")

    def scalar(self, place: int, parent: int, depth: int) -> Any:
        """A value that begins at a place of the line that is read, in a node indented by `parent`."""
        self.inline = None
        first = self.text[place]
        if first in "|>":
            return self.literal(self.rest(place), parent)
        if first in "\"'[{":
            value, end = self.flow(place, depth)
            tail = self.rest(end)
            if tail.strip() and not re.match(r"\s+#", tail):
                raise YamlError("content after a value")
            while self.at + 1 < len(self.starts) and self.starts[self.at + 1] <= end:
                self.at += 1
            self.at += 1
            return value
        if first in _INDICATORS or (first in "-?:" and not self.rest(place)[1:2].strip()):
            raise YamlError(f"{first} at the start of a value")
        parts = [self.plain_part(self.rest(place))]
        self.at += 1
        if "#" not in self.rest(place) or not re.search(r"\s#", self.rest(place)):
            self.fold(parts, parent)
        return plain_value("".join(parts))

    def plain_part(self, line: str) -> str:
        line = re.split(r"\s#", line, maxsplit=1)[0].strip()
        if re.search(r":(\s|$)", line):
            raise YamlError("a mapping inside a value")
        return line

    def fold(self, parts: list[str], parent: int) -> None:
        """Add the lines that go on with a plain scalar: a blank for a line break, a line break for each blank line."""
        breaks = 0
        while self.at < len(self.starts):
            line = self.line(self.at)
            body = line.strip()
            if not body:
                breaks += 1
                self.at += 1
                continue
            if len(line) - len(line.lstrip(" ")) <= parent or body[0] == "#" or re.match(r"(\.\.\.|---)(\s|$)", line):
                return
            parts += ["\n" * breaks or " ", self.plain_part(line)]
            breaks = 0
            self.at += 1
            if re.search(r"\s#", line):
                return

    def literal(self, header: str, parent: int) -> str:
        """A block scalar, folded or as it stands."""
        m = _HEADER.match(header)
        if not m:
            raise YamlError("no such block scalar")
        chomp, digit = m[2] or m[5] or "", m[3] or m[4]
        self.at += 1
        indent = max(parent, 0) + int(digit) if digit else 0
        lines = []
        while self.at < len(self.starts):
            line = self.line(self.at)
            depth = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if not indent:
                    indent = depth
                if depth < indent or indent <= parent:
                    break
            lines.append(line[indent:] if indent else "")
            self.at += 1
        if self.at == len(self.starts) and lines and self.text.endswith("\n"):
            lines.pop()  # what stands after the last line break is no line
        end = len(lines)
        while end and not lines[end - 1]:
            end -= 1
        body, blanks = lines[:end], len(lines) - end
        text = "\n".join(body) if m[1] == "|" else self.folded(body)
        if not body:
            return "\n" * blanks if chomp == "+" else ""
        return text + {"-": "", "": "\n", "+": "\n" * (1 + blanks)}[chomp]

    @staticmethod
    def folded(lines: list[str]) -> str:
        out, breaks, before = "", 0, None
        for line in lines:
            if not line:
                breaks += 1
                continue
            deep = line[0] in " \t"
            if before is None:
                out += "\n" * breaks
            elif deep or before:
                out += "\n" * (breaks + 1)
            else:
                out += "\n" * breaks or " "
            out, breaks, before = out + line, 0, deep
        return out

    def blank(self, place: int) -> int:
        """The next place in a flow collection that is no white space or comment."""
        while place < len(self.text):
            if self.text[place] in " \t\n":
                place += 1
            elif self.text[place] == "#" and self.text[place - 1] in " \t\n":
                place += len(self.rest(place))
            else:
                return place
        raise YamlError("an open collection")

    def flow(self, place: int, depth: int) -> tuple[Any, int]:
        """(value, place after it) of a quoted scalar or flow collection."""
        if depth > DEPTH:
            raise YamlError("nested too deep")
        first = self.text[place]
        if first in "\"'":
            return self.quoted(place)
        if first == "[":
            items: list = []
            place = self.blank(place + 1)
            while self.text[place] != "]":
                value, place = self.item(place, depth + 1)
                place = self.blank(place)
                if self.text[place] == ":":
                    inner, place = self.item(self.blank(place + 1), depth + 1)
                    value, place = {value: inner}, self.blank(place)
                items.append(value)
                place = self.separator(place, "]")
            return items, place + 1
        pairs: dict = {}
        place = self.blank(place + 1)
        while self.text[place] != "}":
            key, place = self.item(place, depth + 1)
            place, value = self.blank(place), None
            if self.text[place] == ":":
                place = self.blank(place + 1)
                if self.text[place] not in ",}":
                    value, place = self.item(place, depth + 1)
                    place = self.blank(place)
            key = key if isinstance(key, str) else text_of(key) or ""
            if key in pairs:
                raise YamlError(f"{key} twice")
            pairs[key] = value
            place = self.separator(place, "}")
        return pairs, place + 1

    def separator(self, place: int, end: str) -> int:
        if self.text[place] == ",":
            return self.blank(place + 1)
        if self.text[place] != end:
            raise YamlError("no comma between items")
        return place

    def item(self, place: int, depth: int) -> tuple[Any, int]:
        """A value inside a flow collection."""
        if self.text[place] in "\"'[{":
            return self.flow(place, depth)
        m = re.compile(r"(?:[^,\[\]{}:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)+").match(self.text, place)
        if not m or m[0][0] in _INDICATORS or m[0].strip() in ("-", "?"):
            raise YamlError("no value in a collection")
        end, words = m.end(), [m[0].strip()]
        while self.text[end : end + 1] == "\n":  # a plain scalar may go on
            nxt = self.blank(end)
            more = re.compile(r"(?:[^,\[\]{}:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)+").match(self.text, nxt)
            if not more:
                return plain_value(" ".join(words)), nxt
            words.append(more[0].strip())
            end = more.end()
        return plain_value(" ".join(words)), end

    def quoted(self, place: int) -> tuple[str, int]:
        quote, out, i = self.text[place], [], place + 1
        stop = re.compile(r"['\n]" if quote == "'" else r'["\\\n]')
        while True:
            m = stop.search(self.text, i)
            if not m:
                raise YamlError("an open quote")
            out.append(self.text[i : m.start()])
            i, c = m.end(), m[0]
            if c == "\n":
                breaks = re.compile(r"[ \t]*(?:\n[ \t]*)*").match(self.text, i)
                out[-1] = out[-1].rstrip(" \t")
                out.append("\n" * breaks[0].count("\n") or " ")
                i = breaks.end()
            elif c == "\\":
                e = self.text[i : i + 1]
                if e in _WIDTHS:
                    code = self.text[i + 1 : i + 1 + _WIDTHS[e]]
                    if not re.fullmatch(r"[0-9a-fA-F]+", code) or len(code) < _WIDTHS[e] or int(code, 16) > 0x10FFFF or 0xD800 <= int(code, 16) < 0xE000:
                        raise YamlError("no such character")
                    out.append(chr(int(code, 16)))
                    i += 1 + _WIDTHS[e]
                elif e == "\n":
                    i = re.compile(r"\n[ \t]*").match(self.text, i).end()
                elif e and e in _ESCAPES:
                    out.append(_ESCAPES[e])
                    i += 1
                else:
                    raise YamlError("no such escape")
            elif quote == "'" and self.text[i : i + 1] == "'":
                out.append("'")
                i += 1
            else:
                return "".join(out), i


def parse(text: str) -> Any:
    """The value of a document; YamlError if it is malformed."""
    return Reader(text).document()


def text_of(value: Any) -> str | None:
    """A value as text: numbers in their shortest form, collections as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        x = float(value) if abs(value) < 1e300 else value
        if isinstance(x, float) and (math.isinf(x) or math.isnan(x)):
            return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        return re.sub(r"e([+-])0*(\d)", r"e\1\2", repr(float(x)))
    return json.dumps(value, ensure_ascii=False)


def column(text: Column, shape: Callable[[Any, bool], Any], kind: str, arrow: pa.DataType) -> Column:
    """shape(value, malformed) of each text, in Arrow batches; null for a null text."""

    @F.arrow_udf(kind)
    def read(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else shape(parse(t), False))
            except YamlError:
                out.append(shape(None, True))
        return pa.array(out, arrow)

    return read(text)


def records(text: Column, keys: tuple[str, ...], strings: tuple[str, ...] = ()) -> Column:
    """array<struct<keys>> of the mappings in a list, values as text; empty where the text is null, malformed or no list.

    Values of the keys in `strings` that are no text count as absent.
    """

    def shape(value: Any, malformed: bool) -> list:
        items = [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []
        return [{k: None if k in strings and not isinstance(x.get(k), str) else text_of(x.get(k)) for k in keys} for x in items]

    kind = "array<struct<" + ",".join(f"{k}:string" for k in keys) + ">>"
    found = column(text, shape, kind, pa.list_(pa.struct([(k, pa.string()) for k in keys])))
    return F.coalesce(found, F.array().cast(kind))
