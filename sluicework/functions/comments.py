"""Comments, lint directives and suppression directives as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = r"/{2}\s*+(ignore(?:_for_file)?)\s*:(.*)"
LINTS = r"^\s*([A-Za-z][A-Za-z0-9_]*(?:\s*,\s*[A-Za-z][A-Za-z0-9_]*)*)"
#: Suppression directive of this engine.
DIRECTIVE = "// sluice-ignore:"


def normal_comment(lexeme: Column) -> Column:
    """A line comment's words: no slashes, no outer blanks, lower case, without closing punctuation."""
    body = F.regexp_replace(F.lower(lexeme), r"^\s*//", "")
    return F.regexp_replace(F.regexp_replace(body, r"^\s+", ""), r"[.,:;!\s]+$", "")


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*//")


def ignore_kind(line: Column) -> Column:
    """'ignore', 'ignore_for_file' or '' for no directive."""
    return F.regexp_extract(line, IGNORE, 1)


def lint_names(rest: Column) -> Column:
    """The lints that open a directive's text: split, trimmed, sorted, joined by commas."""
    found = F.regexp_extract(rest, LINTS, 1)
    names = F.filter(F.transform(F.split(found, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(F.array_sort(names), ",")


def reason(rest: Column) -> Column:
    """What follows the lints of a directive, without separators."""
    after = F.regexp_replace(rest, LINTS, "")
    return F.regexp_replace(after, r"^[\s\-–—:/]+|\s+$", "")


def directive_rule(lexeme: Column, prefix: str = DIRECTIVE) -> Column:
    """The rule that a suppression names; null unless it begins with the prefix and gives a rule and a reason."""
    rest = F.regexp_replace(F.substr(lexeme, F.lit(len(prefix) + 1)), r"^\s+|\s+$", "")
    rule = F.regexp_extract(rest, r"^(\S+)", 1)
    why = F.regexp_replace(F.regexp_replace(rest, r"^\S+", ""), r"^[\s\-–:]+", "")
    return F.when(lexeme.startswith(prefix) & (rule != "") & (why != ""), rule)
