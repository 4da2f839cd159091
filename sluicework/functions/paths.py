"""Predicates on project-relative POSIX paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATED_ENDS = (".g.dart", ".freezed.dart", ".mocks.dart")
L10N_START = "app_localizations"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def in_dirs(path: Column, dirs) -> Column:
    """Whether a path has a directory and the first one is among dirs."""
    parts = F.split(path, "/")
    return (F.size(parts) > 1) & F.element_at(parts, 1).isin(*dirs)


def any_end(name: Column, ends) -> Column:
    return reduce(lambda a, b: a | b, [name.endswith(e) for e in ends], F.lit(False))


def generated(path: Column, ends=GENERATED_ENDS, start: str = L10N_START, start_end: str = ".dart") -> Column:
    """Whether a file's name says that a generator wrote it."""
    name = basename(path)
    return any_end(name, ends) | (name.startswith(start) & name.endswith(start_end))


def under_lib(path: Column) -> Column:
    return path.startswith("lib/")


def public_api(path: Column) -> Column:
    """lib but not lib/src: what other packages may import."""
    return path.startswith("lib/") & ~path.startswith("lib/src/")


def glob_regex(glob: str) -> str:
    """A regular expression for a project-relative glob.

    ``*`` and ``?`` stay inside a directory, ``**`` crosses them, ``**/`` also matches no directory, ``{a,b}`` is a
    choice and ``[ab]`` a set. The expression is in the subset that Java and RE2 share.
    """
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 1
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs], F.lit(False))
