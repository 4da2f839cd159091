"""Lexer of Dart sources: tokens, comments and line starts."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

KEYWORDS = frozenset(
    "abstract as assert async await base break case catch class const continue covariant default deferred do dynamic else enum export extends extension external factory false final finally for Function get hide if implements import in interface is late library mixin new null on operator part required rethrow return sealed set show static super switch sync this throw true try typedef var void when while with yield".split()
)
#: Words that can also be names.
SOFT = frozenset("abstract as async base covariant deferred dynamic export extension external factory Function get hide implements import interface late library mixin on operator part required sealed set show static sync typedef when".split())
_ID = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
#: What begins behind blanks: a name, a plain string, the start of another string, a comment, the start of a block comment, a number, an operator.
_NEXT = re.compile(
    r"\s*+(?:(?!r['\"])([A-Za-z_$][A-Za-z0-9_$]*)"
    r"|(r?(?:'(?!'')[^'\\$\n]*'|\"(?!\"\")[^\"\\$\n]*\"))"
    r"|(r?['\"])"
    r"|(//[^\n]*)"
    r"|(/\*)"
    r"|(0[xX][0-9a-fA-F_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?)"
    r"|(\?\?=|>>>=|\.\.\.\?|\.\.\.|\?\.\.|<<=|=>|\?\?|\?\.|\.\.|&&|\|\||==|!=|<=|\+\+|--|\+=|-=|\*=|~/=|/=|%=|&=|\|=|\^=|~/|<<|[-+*/%=<>!~&|^?:;,.(){}\[\]@#$\\]))"
)
_BLANK = re.compile(r"\s*")
_BRACKETS = frozenset(("(", ")", "[", "]", "{", "}", "${"))
_PAIR = {")": ("(",), "]": ("[",), "}": ("{", "${")}


class SourceError(Exception):
    """A text that can't be cut into tokens or matched brackets."""


@dataclass(slots=True)
class Token:
    kind: str  # id, kw, lit, op
    text: str
    at: int


@dataclass(slots=True)
class Comment:
    style: str  # line, doc, block
    text: str
    at: int
    next_token: int  # number of the token that follows


class Source:
    """Tokens and comments of a text; ``match`` has the other bracket of every bracket."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[Token] = []
        self.comments: list[Comment] = []
        self._lex(0, len(text), None)
        self.match: dict[int, int] = {}
        match, open_ = self.match, []
        for i, t in enumerate(self.tokens):
            x = t.text
            if x not in _BRACKETS or t.kind != ("lit" if x == "${" else "op"):
                continue
            own = _PAIR.get(x)
            if own is None:
                open_.append(i)
                continue
            if not open_ or self.tokens[open_[-1]].text not in own:
                raise SourceError(f"unmatched {x} at line {self.line(t.at)}")
            j = open_.pop()
            match[i], match[j] = j, i
        if open_:
            raise SourceError(f"unclosed {self.tokens[open_[-1]].text} at line {self.line(self.tokens[open_[-1]].at)}")

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        return at - self.starts[self.line(at) - 1] + 1

    def _lex(self, i: int, end: int, until: str | None) -> int:
        """Adds the tokens of text[i:end]; with until, stops behind the closing brace of an interpolation."""
        text, depth, add = self.text, 0, self.tokens.append
        while m := _NEXT.match(text, i):
            kind = m.lastindex
            x, at, i = m[kind], m.start(kind), m.end()
            if kind == 1:
                add(Token("kw" if x in KEYWORDS else "id", x, at))
            elif kind == 7:
                if until and x in ("{", "}"):
                    if x == "}" and not depth:
                        add(Token("op", x, at))
                        return i
                    depth += 1 if x == "{" else -1
                add(Token("op", x, at))
            elif kind in (2, 6):
                add(Token("lit", x, at))
            elif kind == 3:
                i = self._string(at, end)
            elif kind == 4:
                self.comments.append(Comment("doc" if x.startswith("///") else "line", x.rstrip("\r"), at, len(self.tokens)))
            else:
                i, nested = at + 2, 1
                while nested:
                    a, b = text.find("*/", i), text.find("/*", i)
                    if a < 0:
                        raise SourceError(f"unclosed comment at line {self.line(at)}")
                    if 0 <= b < a:
                        nested, i = nested + 1, b + 2
                    else:
                        nested, i = nested - 1, a + 2
                self.comments.append(Comment("block", text[at:i], at, len(self.tokens)))
        i = _BLANK.match(text, i).end()
        if i < end:
            raise SourceError(f"unexpected character at line {self.line(i)}")
        if until:
            raise SourceError(f"unclosed interpolation at line {self.line(i)}")
        return i

    def _string(self, i: int, end: int) -> int:
        text, begin = self.text, i
        raw = text[i] == "r"
        i += raw
        quote = text[i] * 3 if text.startswith(text[i] * 3, i) else text[i]
        piece, i = i - raw, i + len(quote)
        while True:
            if i >= end or (len(quote) == 1 and text[i] == "\n"):
                raise SourceError(f"unclosed string at line {self.line(begin)}")
            if text.startswith(quote, i):
                self.tokens.append(Token("lit", text[piece : i + len(quote)], piece))
                return i + len(quote)
            if raw or text[i] not in "\\$":
                i += 1
            elif text[i] == "\\":
                i += 2
            elif text.startswith("${", i):
                self.tokens.append(Token("lit", text[piece:i], piece))
                self.tokens.append(Token("lit", "${", i))
                piece = i = self._lex(i + 2, end, "}")
            else:
                m = _ID.match(text, i + 1)
                if not m:
                    i += 1
                    continue
                self.tokens.append(Token("lit", text[piece:i], piece))
                self.tokens.append(Token("lit", "$", i))
                name = re.match(r"[A-Za-z_][A-Za-z0-9_]*", text[i + 1 :]).group() if text[i + 1] != "$" else m.group()
                self.tokens.append(Token("kw" if name in KEYWORDS else "id", name, i + 1))
                piece = i = i + 1 + len(name)
