"""Position-free identities of findings and rule sets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = 16


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def fingerprint(rule: Column, path: Column, anchor: Column) -> Column:
    """First 16 hex digits of SHA-256 over rule, POSIX path and anchor, separated by NUL. Null if any part is null."""
    nul = F.lit("\0")
    return F.substring(F.sha2(F.concat(rule, nul, posix(path), nul, anchor), 256), 1, HEX)


def fingerprint_of(rule: str, path: str, anchor: str) -> str:
    """`fingerprint` of plain strings."""
    raw = "\0".join((rule, path.replace("\\", "/"), anchor))
    return hashlib.sha256(raw.encode()).hexdigest()[:HEX]


def ruleset_version(ids: Column) -> Column:
    """Aggregate: version of a set of rule ids, whatever their order and repetition."""
    joined = F.array_join(F.sort_array(F.collect_set(ids)), "\n")
    return F.concat(F.lit("ruleset@"), F.substring(F.sha2(joined, 256), 1, 8))


def ruleset_version_of(ids) -> str:
    return "ruleset@" + hashlib.sha256("\n".join(sorted(set(ids))).encode()).hexdigest()[:8]
