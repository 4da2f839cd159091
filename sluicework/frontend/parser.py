"""Structural parser of Dart sources: flat facts about one file.

It follows brackets, declarations and statements; it doesn't resolve types. A fact is a dict with the columns of
`FACT_COLUMNS`. Kinds of facts:

file (name: its status), uri (name: import, export, part or part of), comment, decl, supertype, ref, unit (executable
bodies that count for complexity), point (decision points), body (token sequences for clones), catch, node (calls of
names that look like constructors, with their arguments).
"""

from __future__ import annotations

import re

from .lexer import KEYWORDS, SOFT, Source, SourceError, Token

FACT_COLUMNS = "path string, fact string, line int, col int, end_line int, name string, owner string, pre int, post int, seq int, props map<string,string>, items array<string>"
_CLASSES = ("class", "mixin", "enum", "extension")
_MODIFIERS = frozenset("external static abstract covariant late final const var factory required sealed base interface async augment".split())
#: Tokens that a walk through an expression stops at, but for names.
_MARKS = frozenset((",", ";", "=", ":", "??", "&&", "||", "?", "switch", "(", "[", "{", "${"))
_STATEMENTS = frozenset("if for while do switch try return throw break continue assert rethrow yield".split())


class Parser:
    def __init__(self, path: str, text: str, kinds: frozenset[str] | None = None):
        self.path, self.facts, self.number, self.kinds = path, [], 0, kinds
        self.src = Source(text)
        self.t: list[Token] = self.src.tokens
        #: The tokens' texts, with empty ones behind the end (and so before the start).
        self.x = [*(t.text for t in self.t), "", "", "", ""]
        self.last = len(self.t) + 3
        self.named = [t.kind == "id" or t.text in SOFT for t in self.t]
        self.match = self.src.match
        self.names: set[int] = set()  # token numbers of declared names
        self.unit: tuple[str, int] | None = None
        self.member = ""
        self.part_of = False

    # helpers

    def text(self, i: int) -> str:
        return self.x[i] if -1 <= i < self.last else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.named) and self.named[i]

    def wanted(self, fact: str) -> bool:
        return self.kinds is None or fact in self.kinds or fact == "file"

    def line(self, i: int) -> int:
        return self.src.line(self.t[min(i, len(self.t) - 1)].at) if self.t else 1

    def add(self, fact: str, i: int | None = None, **more) -> dict:
        """The row of a fact, which is kept if its kind is wanted."""
        row = dict(path=self.path, fact=fact, line=None, col=None, end_line=None, name=None, owner=None, pre=None, post=None, seq=None, props={}, items=[])
        if not self.wanted(fact):
            return row | more
        if i is not None and i < len(self.t):
            at = self.t[i].at
            row["line"] = line = self.src.line(at)
            row["col"] = at - self.src.starts[line - 1] + 1
        row |= more
        self.facts.append(row)
        return row

    def next_number(self) -> int:
        self.number += 1
        return self.number

    def skip_types(self, i: int, end: int) -> int:
        """Behind the type arguments that begin at i, or i if there are none."""
        if self.text(i) != "<":
            return i
        depth, j = 0, i
        while j < end:
            x = self.text(j)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x in ("(", "[", "{"):
                if x == "{" and depth < 1:
                    return i
                j = self.match[j]
            elif self.t[j].kind == "lit" or x in (";", "&&", "||", "==", ")", "]", "}", "=>", "=", "+", "-"):
                return i
            j += 1
        return i

    def annotations(self, i: int, end: int) -> tuple[list[str], int]:
        found = []
        while i < end and self.text(i) == "@":
            j = i + 1
            while self.is_name(j) and self.text(j + 1) == ".":
                j += 2
            found.append(self.text(j))
            j = self.skip_types(j + 1, end)
            if self.text(j) == "(" and self.t[j].at == self.t[j - 1].at + len(self.text(j - 1)):
                j = self.match[j] + 1
            i = j
        return found, i

    def statement_end(self, i: int, end: int) -> int:
        """The number of the ; that ends what begins at i, or end."""
        while i < end:
            x = self.t[i]
            if x.text == ";" and x.kind == "op":
                return i
            if i in self.match and self.match[i] > i:
                i = self.match[i]
            i += 1
        return end

    # units and members

    def run(self) -> list[dict]:
        n = len(self.t)
        i = 0
        while i < n:
            i = max(i + 1, self.declaration(i, n, None))
        if self.wanted("ref"):
            seen = {}
            for k, named in enumerate(self.named):
                if named and k not in self.names:
                    seen.setdefault(self.x[k], k)
            for name, k in seen.items():
                self.add("ref", k, name=name)
        for c in self.src.comments if self.wanted("comment") else ():
            self.add("comment", line=self.src.line(c.at), col=self.src.column(c.at), end_line=self.src.line(c.at + len(c.text)), name=c.text, seq=c.next_token, props={"style": c.style})
        self.add("file", line=1, end_line=len(self.src.starts), name="ok", props={"part": str(self.part_of).lower()})
        return self.facts

    def declaration(self, i: int, end: int, owner: str | None, owner_kind: str = "") -> int:
        """Parses the declaration at i; the result is behind it."""
        first = i
        notes, i = self.annotations(i, end)
        x = self.text(i)
        if owner is None and x in ("import", "export", "part", "library") and self.text(i + 1) not in ("(", "=", ";", ".") or (x == "library" and owner is None):
            j = self.statement_end(i, end)
            kind = "part of" if x == "part" and self.text(i + 1) == "of" else x
            uri = next((self.t[k].text.strip("'\"") for k in range(i + 1, j) if self.t[k].kind == "lit"), "")
            self.part_of |= kind == "part of"
            if kind != "library":
                self.add("uri", i, name=kind, props={"uri": uri})
            return j + 1
        if owner is None:
            j = i
            while self.text(j) in ("abstract", "sealed", "base", "interface", "final", "mixin") and (self.text(j + 1) in ("class", "mixin", "sealed", "base", "interface", "final")):
                j += 1
            if self.text(j) in _CLASSES and (self.is_name(j + 1) or self.text(j) == "extension") and self.text(j + 1) not in ("(", "=", ";"):
                return self.class_like(j, end, notes, "abstract" in [self.text(k) for k in range(i, j)], first)
            if x == "typedef":
                j = self.statement_end(i, end)
                k = i + 1
                while k < j and self.text(k) not in ("=",):
                    k += 1
                name = k - 1 if k < j else next((q - 1 for q in range(i + 2, j) if self.text(q) == "("), i + 1)
                while name > i and self.text(name) == ">":
                    name -= 1
                self.declare(name, "typedef", None, notes)
                return j + 1
        return self.member_at(i, end, owner, owner_kind, notes, first)

    def declare(self, i: int, kind: str, owner: str | None, notes: list[str], first: int | None = None, **props) -> dict:
        self.names.add(i)
        at = i if first is None else first
        return self.add("decl", i, name=self.text(i), owner=owner, items=notes, seq=at, props={"kind": kind, "token": str(at)} | {k: str(v).lower() for k, v in props.items()})

    def class_like(self, i: int, end: int, notes: list[str], abstract: bool, first: int) -> int:
        kind = self.text(i)
        i += 1
        if kind == "mixin" and self.text(i) == "class":
            i += 1
        if kind == "extension" and self.text(i) == "type":
            i += 1
        anonymous = kind == "extension" and self.text(i) in ("on", "<")
        name = "" if anonymous else self.text(i)
        if not anonymous:
            self.declare(i, kind, None, notes, first, abstract=abstract)
            i += 1
        i = self.skip_types(i, end)
        if self.text(i) == "=":  # a mixin application
            i += 1
            self.supertype(name, i, "extends")
        clause = ""
        while i < end and self.text(i) not in ("{", ";"):
            x = self.text(i)
            if x in ("extends", "with", "implements", "on"):
                clause = x
            elif clause and self.is_name(i) and self.text(i - 1) in (clause, ",", "with", "implements", "extends", "on"):
                i = self.supertype(name, i, clause)
                continue
            elif x == "(":
                i = self.match[i]
            i += 1
        if i >= end or self.text(i) == ";":
            return i + 1
        close = self.match[i]
        i += 1
        if kind == "enum":
            while i < close and self.text(i) != ";":
                skipped, i = self.annotations(i, close)
                if self.is_name(i):
                    self.declare(i, "enum constant", name, skipped)
                    i = self.skip_types(i + 1, close)
                    if self.text(i) == ".":
                        i += 2
                    if self.text(i) == "(":
                        self.expression(i, self.match[i] + 1, 0)
                        i = self.match[i] + 1
                    if self.text(i) == ",":
                        i += 1
                elif self.text(i) != ";":
                    i += 1
            i += 1
        while i < close:
            i = max(i + 1, self.declaration(i, close, name, kind))
        return close + 1

    def supertype(self, name: str, i: int, clause: str) -> int:
        while self.text(i + 1) == "." and self.is_name(i + 2):
            i += 2
        self.add("supertype", i, name=name, props={"super": self.text(i), "clause": clause})
        return self.skip_types(i + 1, len(self.t))

    def member_at(self, i: int, end: int, owner: str | None, owner_kind: str, notes: list[str], first: int) -> int:
        flags, start = set(), i
        while self.text(i) in _MODIFIERS and self.text(i + 1) not in ("(", "=", ";", ","):
            flags.add(self.text(i))
            i += 1
        j, accessor, name = i, "", None
        while j < end:
            x = self.text(j)
            if x in ("get", "set") and (self.is_name(j + 1) or self.text(j + 1) in KEYWORDS) and self.text(j + 1) not in ("(",) and self.t[j].kind == "kw":
                accessor, name = x, j + 1
                j += 2
                continue
            if x == "operator" and self.text(j + 1) not in ("=", ";", "(", ","):
                k = j + 1
                while k < end and (self.text(k) != "(" or k == j + 1 and self.text(k) == "("):
                    k += 1
                return self.function(k, end, owner, notes, first, j, "operator", flags, "operator " + "".join(self.text(q) for q in range(j + 1, k)), i)
            if x == "(":
                if self.text(j - 1) == "Function" or j == i:  # a function type or a record
                    j = self.match[j] + 1
                    if self.text(j) == "?":
                        j += 1
                    continue
                if name is None:
                    name = j - 1
                    if self.text(name) == ">":
                        name = self._before_types(name, i)
                break
            if x in (";", "=", "{", "=>", ",", "}"):
                if name is None:
                    name = j - 1
                break
            k = self.skip_types(j, end)
            j = k if k > j else j + 1
        if j >= end or name is None or name < start or not self.is_name(name):
            stop = self.statement_end(start, end)
            if self.text(j) == "{" and j in self.match:
                stop = self.match[j]
            return stop + 1
        if self.text(j) == "(" or self.text(j) in ("{", "=>") and accessor:
            constructor = owner is not None and not accessor and (self.text(name) == owner and self.text(name - 1) != "." or self.text(name - 1) == "." and self.text(name - 2) == owner or self.text(name) == "new" and self.text(name - 2) == owner)
            if constructor:
                named = self.text(name - 1) == "."
                label = f"{owner}.{self.text(name)}" if named else f"{owner}.new"
                return self.function(j, end, owner, notes, first, name, "constructor", flags, label, i)
            kind = {"get": "getter", "set": "setter"}.get(accessor, "method" if owner is not None else "function")
            label = (f"{owner}." if owner else "") + self.text(name) + ("=" if accessor == "set" else "")
            return self.function(j, end, owner, notes, first, name, kind, flags, label, i)
        kind = "field" if owner is not None else "variable"
        stop = self.statement_end(start, end)
        while True:  # a list of variables
            self.declare(name, kind, owner, notes, first, static="static" in flags, abstract="abstract" in flags)
            k = j
            while k < stop and self.text(k) != ",":
                k = self.match[k] if k in self.match and self.match[k] > k else k
                k += 1
            if self.text(j) == "=":
                self.member = f"{owner}.{self.text(name)}" if owner else self.text(name)
                self.unit = None
                self.expression(j + 1, min(k, stop), 0)
            if k >= stop or not self.is_name(k + 1):
                break
            name, j = k + 1, k + 2
        return stop + 1

    def _before_types(self, close: int, least: int) -> int:
        depth = 0
        for k in range(close, least, -1):
            depth += (self.text(k) == ">") - (self.text(k) == "<")
            if not depth:
                return k - 1
        return close - 1

    def function(self, i: int, end: int, owner, notes, first, name: int, kind: str, flags: set, label: str, begin: int) -> int:
        """A function whose parameters or body begin at i; begin is where its return type does."""
        returns = "".join(self.text(k) for k in range(begin, name) if self.text(k) not in ("get", "set"))
        plain = self.text(name) if kind != "operator" else label
        if self.text(i) == "(":
            self.parameters(i)
            i = self.match[i] + 1
        j = i
        if self.text(j) == ":":  # initialisers of a constructor
            j += 1
            while j < end and self.text(j) not in ("{", ";", "=>"):
                j = self.match[j] if j in self.match and self.match[j] > j else j
                j += 1
            while self.text(j) == "{" and self.text(self.match[j] + 1) in (",", "."):
                j = self.match[j] + 1
                while j < end and self.text(j) not in ("{", ";"):
                    j = self.match[j] if j in self.match and self.match[j] > j else j
                    j += 1
        while self.text(j) in ("async", "sync", "*", "async*"):
            j += 1
        has_body = self.text(j) in ("{", "=>")
        row = self.declare(
            name, kind, owner, notes, first, static="static" in flags, abstract=not has_body and kind != "constructor" and "external" not in flags, label=label, override="override" in notes
        )
        row["props"]["label"] = label
        if kind == "operator":
            row["name"] = plain
        build = kind in ("method", "function") and plain == "build" and (returns.rstrip("?") == "Widget" or returns.rstrip("?").endswith("Widget"))
        self.member = label
        number = self.next_number()
        unit = None
        if has_body:
            unit = (label, number)
            self.add("unit", name, name=label, owner=owner, pre=number, props={"build": str(build).lower(), "kind": kind})
        saved, self.unit = self.unit, unit
        if i < j:
            self.expression(i, j, 0)
        if self.text(j) == "{":
            self.body(j, self.match[j], name)
            self.block(j + 1, self.match[j], 0)
            stop = self.match[j] + 1
        elif self.text(j) == "=>":
            stop = self.statement_end(j, end)
            self.body(j + 1, stop, name)
            self.expression(j + 1, stop, 0)
            stop += 1
        else:
            stop = self.statement_end(j, end) + 1
        self.unit = saved
        return stop

    def parameters(self, i: int) -> None:
        """Defaults inside a parameter list count as expressions outside any unit."""
        saved, self.unit = self.unit, None
        k, close = i + 1, self.match[i]
        while k < close:
            if self.text(k) == "=":
                j = k + 1
                while j < close and self.text(j) not in (",", "}", "]"):
                    j = self.match[j] if j in self.match and self.match[j] > j else j
                    j += 1
                self.expression(k + 1, j, 0)
                k = j
            k += 1
        self.unit = saved

    def body(self, i: int, j: int, name: int) -> None:
        inner = range(i + 1, j) if self.text(i) == "{" else range(i, j)
        if not len(inner):
            return
        number = self.next_number()
        if self.wanted("body"):
            kinds = ["id" if t.kind == "id" else "lit" if t.kind == "lit" or t.text in ("true", "false", "null") else "other" for t in (self.t[k] for k in inner)]
            self.add("body", name, end_line=self.line(min(j, len(self.t) - 1)), name=self.text(name), pre=number, items=[f"{k}\x01{self.t[q].text}" for k, q in zip(kinds, inner)])

    # statements and expressions

    def point(self, i: int, cyc: int, cog: int, depth: int, nested: bool) -> None:
        if self.unit and self.wanted("point"):
            self.add("point", i, name=self.unit[0], pre=self.unit[1], props={"cyc": str(cyc), "cog": str(cog), "depth": str(depth), "nested": str(nested).lower()})

    def block(self, i: int, end: int, depth: int) -> None:
        while i < end:
            i = max(i + 1, self.statement(i, end, depth))

    def statement(self, i: int, end: int, depth: int) -> int:
        if i >= end:
            return i + 1
        x = self.text(i)
        if x == "{":
            self.block(i + 1, self.match[i], depth)
            return self.match[i] + 1
        if x == ";":
            return i + 1
        if x == "@":
            _, j = self.annotations(i, end)
            return self.statement(j, end, depth)
        if x == "if" and self.text(i + 1) == "(":
            return self.if_statement(i, end, depth, False)
        if x in ("for", "while") or x == "await" and self.text(i + 1) == "for":
            self.point(i, 1, 1, depth, True)
            i += x == "await"
            if self.text(i + 1) == "(":
                self.expression(i + 2, self.match[i + 1], depth + 1)
                return self.statement(self.match[i + 1] + 1, end, depth + 1)
            return i + 1
        if x == "do":
            self.point(i, 1, 1, depth, True)
            j = self.statement(i + 1, end, depth + 1)
            if self.text(j) == "while" and self.text(j + 1) == "(":
                self.expression(j + 2, self.match[j + 1], depth + 1)
                j = self.match[j + 1] + 1
            return j + 1 if self.text(j) == ";" else j
        if x == "switch" and self.text(i + 1) == "(" and self.text(self.match[i + 1] + 1) == "{":
            self.point(i, 0, 1, depth, True)
            self.expression(i + 2, self.match[i + 1], depth)
            j = self.match[i + 1] + 1
            self.switch(j + 1, self.match[j], depth + 1)
            return self.match[j] + 1
        if x == "try" and self.text(i + 1) == "{":
            self.block(i + 2, self.match[i + 1], depth)
            return self.handlers(self.match[i + 1] + 1, end, depth)
        if self.is_name(i) and self.text(i + 1) == ":" :
            return self.statement(i + 2, end, depth)
        local = self.local_function(i, end)
        if local:
            name, params, start, stop, after = local
            self.names.add(name)
            saved, self.member = self.member, f"{self.member}.{self.text(name)}" if self.member else self.text(name)
            self.parameters(params)
            self.body(start if self.text(start) == "{" else start + 1, stop, name)
            if self.text(start) == "{":
                self.block(start + 1, stop, 0)
            else:
                self.expression(start + 1, stop, 0)
            self.member = saved
            return after
        j = self.statement_end(i, end)
        self.expression(i, j, depth)
        return j + 1

    def if_statement(self, i: int, end: int, depth: int, chained: bool) -> int:
        self.point(i, 1, 1, depth, not chained)
        close = self.match[i + 1]
        case = self.find("case", i + 2, close)
        self.expression(i + 2, close if case is None else case, depth)
        if case is not None:  # a pattern has no decisions, its guard has
            self.guard(case + 1, close, depth)
        j = self.statement(close + 1, end, depth + 1)
        if self.text(j) == "else" and j < end:
            if self.text(j + 1) == "if" and self.text(j + 2) == "(":
                return self.if_statement(j + 1, end, depth, True)
            self.point(j, 0, 1, depth, False)
            return self.statement(j + 1, end, depth + 1)
        return j

    def find(self, word: str, i: int, end: int) -> int | None:
        """The first place of a word outside brackets."""
        while i < end:
            if self.text(i) == word:
                return i
            i = self.match[i] + 1 if i in self.match and self.match[i] > i else i + 1
        return None

    def guard(self, i: int, end: int, depth: int) -> None:
        """The guard of the pattern that begins at i, if it has one."""
        when = self.find("when", i + 1, end)
        if when is not None:
            self.point(when, 1, 1, depth, False)
            self.expression(when + 1, end, depth)

    def switch_expression(self, i: int, end: int, depth: int) -> int:
        """A switch with values at i; the result is behind it."""
        self.expression(i + 2, self.match[i + 1], depth)
        k, close = self.match[i + 1] + 2, self.match[self.match[i + 1] + 1]
        while k < close:
            arrow = self.find("=>", k, close)
            if arrow is None:
                break
            self.guard(k, arrow, depth)
            stop = arrow + 1
            while stop < close and self.text(stop) != ",":
                stop = self.match[stop] + 1 if stop in self.match and self.match[stop] > stop else stop + 1
            self.expression(arrow + 1, stop, depth)
            k = stop + 1
        return min(close + 1, end)

    def switch(self, i: int, end: int, depth: int) -> None:
        while i < end:
            x = self.text(i)
            if x in ("case", "default"):
                if x == "case":
                    self.point(i, 1, 0, depth, False)
                k, questions = i + 1, 0
                while k < end and not (self.text(k) == ":" and not questions):
                    questions += (self.text(k) == "?") - (self.text(k) == ":")
                    k = self.match[k] + 1 if k in self.match and self.match[k] > k else k + 1
                if x == "case":
                    self.guard(i + 1, k, depth)
                i = k + 1
            else:
                i = max(i + 1, self.statement(i, end, depth))

    def handlers(self, i: int, end: int, depth: int) -> int:
        while i < end:
            x = self.text(i)
            if x == "finally":
                self.block(i + 2, self.match[i + 1], depth)
                return self.match[i + 1] + 1
            if x not in ("on", "catch"):
                return i
            j = i
            while j < end and self.text(j) != "{":
                j = self.match[j] + 1 if j in self.match and self.match[j] > j else j + 1
            if j >= end:
                return end
            self.point(i, 1, 1, depth, True)
            close = self.match[j]
            self.block(j + 1, close, depth + 1)
            self.add("catch", i, name=self.member, seq=self.next_number(), props={"tokens": str(close - j - 1)})
            i = close + 1
        return i

    def local_function(self, i: int, end: int):
        """(name, parameters, body start, body end, behind) of a local function at i."""
        if self.text(i) in _STATEMENTS or self.text(i) in ("final", "const", "var", "late", "new", "await", "super", "this"):
            return None
        j = i
        while j < end and (self.is_name(j) or self.text(j) in ("void", "?", ".")):
            k = self.skip_types(j + 1, end)
            j = k if k > j + 1 else j + 1
        if self.text(j) != "(" or j == i:
            return None
        name = j - 1
        if self.text(name) == ">":
            name = self._before_types(name, i)
        if not self.is_name(name) or self.text(name - 1) == "." and name > i:
            return None
        k = self.match[j] + 1
        while self.text(k) in ("async", "sync", "*"):
            k += 1
        if self.text(k) == "{":
            return name, j, k, self.match[k], self.match[k] + 1
        if self.text(k) == "=>":
            stop = self.statement_end(k, end)
            return name, j, k, stop, stop + 1
        return None

    def expression(self, i: int, end: int, depth: int) -> None:
        """Operators, closures, calls and nested brackets of the tokens i..end."""
        segment: list[tuple[int, str]] = []
        xs, named, match = self.x, self.named, self.match
        k = i
        while k < end:
            x = xs[k]
            if named[k]:
                if (x[0].isupper() or xs[k + 1] == ".") and (made := self.creation(k, end)):
                    k = self.node(k, made, end, depth)
                else:
                    k += 1
                continue
            if x not in _MARKS:
                k += 1
                continue
            op = self.t[k].kind == "op"
            if op and x in (",", ";", "=", ":") and not (x == ":" and any(y == "?" for _, y in segment)):
                if segment:
                    self.operators(segment, depth)
                    segment = []
            elif op and x in ("??", "&&", "||", "?", ":"):
                segment.append((k, x))
            elif x == "switch" and xs[k + 1] == "(" and self.text(match[k + 1] + 1) == "{" and match[k + 1] + 1 < end:
                k = self.switch_expression(k, end, depth)
                continue
            if op and x == "(" or x in ("[", "{", "${"):
                close = match.get(k, end)
                if x == "(" and self.closure(k, close, end):
                    k = self.closure_body(k, close, end, depth)
                    continue
                self.expression(k + 1, min(close, end), depth)
                k = close + 1
                continue
            k += 1
        if segment:
            self.operators(segment, depth)

    def operators(self, segment: list[tuple[int, str]], depth: int) -> None:
        questions = []
        for q, (k, x) in enumerate(segment):
            if x == "?":
                questions.append(q)
            elif x == ":" and questions:
                self.point(segment[questions.pop()][0], 1, 1, depth, False)
        runs: list[str] = []
        for q, (k, x) in enumerate(segment):
            if x == "??":
                self.point(k, 1, 1, depth, False)
                runs = []
            elif x in ("?", ":"):
                runs = []
            elif x == "||":
                fresh = "||" not in runs
                self.point(k, 1, int(fresh), depth, False)
                runs = ["||"]
            elif x == "&&":
                fresh = "&&" not in runs
                self.point(k, 1, int(fresh), depth, False)
                runs = [*[r for r in runs if r == "||"], "&&"]

    def closure(self, i: int, close: int, end: int) -> bool:
        j = close + 1
        while self.text(j) in ("async", "sync", "*") and j < end:
            j += 1
        if j >= end or self.text(j) not in ("{", "=>"):
            return False
        before = self.text(i - 1)
        if self.text(j) == "{" and (before == "switch" or self.is_name(i - 1) and self.t[i - 1].kind == "id"):
            return False
        return not (self.text(j) == "=>" and before == "when")

    def closure_body(self, i: int, close: int, end: int, depth: int) -> int:
        self.parameters(i)
        j = close + 1
        while self.text(j) in ("async", "sync", "*"):
            j += 1
        if self.text(j) == "{":
            self.block(j + 1, self.match[j], 0)
            return self.match[j] + 1
        k = j + 1
        while k < end and self.text(k) not in (",", ";"):
            k = self.match[k] + 1 if k in self.match and self.match[k] > k else k + 1
        self.expression(j + 1, min(k, end), 0)
        return min(k, end)

    def creation(self, i: int, end: int):
        """(class token, constructor name, parenthesis) if the name at i looks like a constructor call."""
        xs = self.x
        if xs[i - 1] in (".", "?.") or not (xs[i][:1].isupper() or xs[i + 1] == "." and xs[i + 2][:1].isupper()):
            return None
        k = i
        if not self.text(k)[:1].isupper():
            k += 2
        cls, j = k, self.skip_types(k + 1, end)
        variant = "new"
        if self.text(j) == "." and self.is_name(j + 1):
            variant, j = self.text(j + 1), self.skip_types(j + 2, end)
        if self.text(j) != "(" or j >= end:
            return None
        return cls, variant, j

    def node(self, i: int, made, end: int, depth: int) -> int:
        cls, variant, paren = made
        close = self.match[paren]
        pre = self.next_number()
        props: dict[str, str] = {"variant": variant, "prefix": self.text(i) if cls != i else ""}
        k, wanted = paren + 1, self.wanted("node")
        while k < close:
            j = k
            while j < close and self.text(j) != ",":
                j = self.match[j] + 1 if j in self.match and self.match[j] > j else j + 1
            if self.is_name(k) and self.text(k + 1) == ":":
                if wanted:
                    props["arg:" + self.text(k)] = self.argument(k + 2, j)
                self.names.add(k)
            k = j + 1
        line, owner = self.line(i), self.member
        self.expression(paren + 1, close, depth)
        self.add("node", i, name=self.text(cls), owner=owner, pre=pre, post=self.next_number(), seq=self.number, props=props)["line"] = line
        return close + 1

    def argument(self, i: int, j: int) -> str:
        """What an argument is: its literal, the class of a construction, or 'expr'."""
        i += self.text(i) in ("const", "new")
        if j - i == 1 and (self.t[i].kind == "lit" or self.text(i) in ("null", "true", "false")):
            return self.text(i)
        made = self.creation(i, j) if self.is_name(i) else None
        if made and self.match[made[2]] == j - 1:
            inner = [self.text(k) for k in range(made[2] + 1, j - 1) if self.is_name(k) and self.text(k + 1) == ":" and self._depth_of(k, made[2])]
            return "new " + self.text(made[0]) + "(" + ",".join(inner) + ")"
        return "expr"

    def _depth_of(self, k: int, paren: int) -> bool:
        q = paren + 1
        while q < k:
            q = self.match[q] + 1 if q in self.match and self.match[q] > q else q + 1
        return q == k


def parse(path: str, text: str | None, kinds: frozenset[str] | None = None) -> list[dict]:
    """Facts of one file, of the given kinds and the file's own; a file that can't be parsed has one fact with the reason."""
    if text is None:
        return [_failed(path, "no content")]
    try:
        return Parser(path, text, kinds).run()
    except (SourceError, RecursionError, KeyError, IndexError) as e:
        part = re.search(r"^\s*part\s+of\b", text, re.M) is not None
        return [_failed(path, str(e) or type(e).__name__, part)]


def _failed(path: str, reason: str, part: bool = False) -> dict:
    return dict(path=path, fact="file", line=1, col=None, end_line=None, name="error", owner=None, pre=None, post=None, seq=None, props={"reason": reason, "part": str(part).lower()}, items=[])
