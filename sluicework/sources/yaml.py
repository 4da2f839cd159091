"""Reader of the YAML that configurations and manifests use.

Block and flow maps and lists, plain and quoted scalars, comments, and block texts. Anchors, tags and several documents
are errors.
"""

from __future__ import annotations

import re


class YamlError(ValueError):
    pass


_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`\[\]{},-][^#]*?|-[^\s#][^#]*?|[^\s#]#[^#]*?):(?:\s+(.*)|$)""", re.S)
_INT, _FLOAT = re.compile(r"[-+]?[0-9]+"), re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?")
_PLAIN = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "/": "/", " ": " "}


def load(text: str):
    """The value of a document, None for an empty one."""
    rows = []
    for number, raw in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        line = _bare(raw)
        if line.strip() and not (line.strip() == "---" and not rows):
            if "\t" in line[: len(line) - len(line.lstrip())]:
                raise YamlError(f"line {number}: a tab can't indent")
            rows.append((len(line) - len(line.lstrip()), line.strip(), number))
        else:
            rows.append((-1, raw.strip(), number))
    reader = _Reader(rows)
    reader.skip()
    if reader.at == len(rows):
        return None
    value = reader.block(rows[reader.at][0])
    reader.skip()
    if reader.at < len(rows):
        raise YamlError(f"line {rows[reader.at][2]} can't be read")
    return value


def _bare(line: str) -> str:
    """line without its comment."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif c in "'\"" and (i == 0 or line[i - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


class _Reader:
    def __init__(self, rows: list[tuple[int, str, int]]):
        self.rows, self.at = rows, 0

    def skip(self) -> None:
        while self.at < len(self.rows) and self.rows[self.at][0] < 0:
            self.at += 1

    def block(self, indent: int):
        self.skip()
        _, text, number = self.rows[self.at]
        if text == "-" or text.startswith("- "):
            return self.items(indent)
        if _KEY.fullmatch(text):
            return self.pairs(indent)
        self.at += 1
        while text[0] in "[{" and not _closed(text) and self.at < len(self.rows):  # a flow value over several lines
            text += " " + self.rows[self.at][1]
            self.at += 1
        return scalar(text, number)

    def items(self, indent: int) -> list:
        out = []
        while True:
            self.skip()
            if self.at == len(self.rows) or self.rows[self.at][0] != indent or not (self.rows[self.at][1] + " ").startswith("- "):
                break
            _, text, number = self.rows[self.at]
            rest = text[1:].strip()
            if not rest:
                self.at += 1
                out.append(self.below(indent))
            else:  # what stands behind the dash is a block of its own, indented
                self.rows[self.at] = (indent + text.index(rest, 1), rest, number)
                out.append(self.block(self.rows[self.at][0]))
        return out

    def pairs(self, indent: int) -> dict:
        out: dict = {}
        while True:
            self.skip()
            if self.at == len(self.rows) or self.rows[self.at][0] != indent:
                if self.at < len(self.rows) and self.rows[self.at][0] > indent:
                    raise YamlError(f"line {self.rows[self.at][2]} is indented too far")
                break
            _, text, number = self.rows[self.at]
            m = _KEY.fullmatch(text)
            if not m:
                break
            key, rest = scalar(m.group(1), number), (m.group(2) or "").strip()
            if key in out:
                raise YamlError(f"line {number}: {key} is given twice")
            if not rest:
                self.at += 1
                out[key] = self.below(indent, lists_too=True)
            elif rest[0] in "|>":
                self.at += 1
                out[key] = self.text(indent, rest)
            else:
                self.rows[self.at] = (indent, rest, number)
                self.at += 1
                while rest[0] in "[{" and not _closed(rest) and self.at < len(self.rows):
                    rest += " " + self.rows[self.at][1]
                    self.at += 1
                out[key] = scalar(rest, number)
        return out

    def below(self, indent: int, lists_too: bool = False):
        self.skip()
        if self.at == len(self.rows):
            return None
        inner, text, _ = self.rows[self.at]
        if inner > indent or lists_too and inner == indent and (text + " ").startswith("- "):
            return self.block(inner)
        return None

    def text(self, indent: int, style: str) -> str:
        held = []
        while self.at < len(self.rows) and (self.rows[self.at][0] < 0 or self.rows[self.at][0] > indent):
            held.append(self.rows[self.at][1])
            self.at += 1
        return ("\n" if style[0] == "|" else " ").join(held).strip() + ("" if "-" in style else "\n")


def _closed(text: str) -> bool:
    depth, quote = 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            depth += (c in "[{") - (c in "]}")
    return depth == 0


def scalar(text: str, number: int = 0):
    """The value of a scalar or a flow list or map."""
    value, rest = _flow(text, number)
    if rest.strip():
        raise YamlError(f"line {number} can't be read")
    return value


def _flow(text: str, number: int, inner: bool = False):
    """(value, what is left) of a value at the beginning of text."""
    text = text.lstrip()
    if text[:1] in ("'", '"'):
        return _quoted(text, number)
    if text[:1] in ("[", "{"):
        close, out = "]" if text[0] == "[" else "}", [] if text[0] == "[" else {}
        text = text[1:].lstrip()
        while text[:1] != close:
            if not text:
                raise YamlError(f"line {number}: a {close} is missing")
            value, text = _flow(text, number, True)
            text = text.lstrip()
            if isinstance(out, dict):
                if text[:1] == ":":
                    out[value], text = _flow(text[1:], number, True)
                    text = text.lstrip()
                else:
                    out[value] = None
            else:
                out.append(value)
            if text[:1] == ",":
                text = text[1:].lstrip()
            elif text[:1] != close:
                raise YamlError(f"line {number} can't be read")
        return out, text[1:]
    if text[:1] in ("&", "*", "!", "%", "@", "`"):
        raise YamlError(f"line {number}: {text[0]} isn't supported")
    end = re.search(r"[,\[\]{}]|:(?=\s|$)" if inner else r"$", text).start() if not inner or re.search(r"[,\[\]{}]|:(?=\s|$)", text) else len(text)
    plain, rest = text[:end].strip(), text[end:]
    if not inner and re.search(r":(?=\s|$)", plain):
        raise YamlError(f"line {number} can't be read")
    if plain in _PLAIN:
        return _PLAIN[plain], rest
    return (int(plain) if _INT.fullmatch(plain) else float(plain) if _FLOAT.fullmatch(plain) else plain), rest


def _quoted(text: str, number: int) -> tuple[str, str]:
    if text[0] == "'":
        m = re.match(r"'((?:[^']|'')*)'", text)
        value = m and m.group(1).replace("''", "'")
    else:
        m = re.match(r'"((?:[^"\\]|\\.)*)"', text)
        value = m and re.sub(r"\\(.)", lambda e: _ESCAPES.get(e.group(1), e.group(1)), m.group(1))
    if not m:
        raise YamlError(f"line {number}: a quote is missing")
    return value, text[m.end() :]
