"""Scores and texts of the complexity checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CYCLOMATIC_MAX, COGNITIVE_MAX, COGNITIVE_FLOOR = 20, 30, 5
BUDGET, PENALTY_CAP = 10, 40
GRADES = ((90, "A"), (75, "B"), (60, "C"), (45, "D"))


def grade(score: Column) -> Column:
    out = None
    for least, letter in GRADES:
        out = F.when(score >= least, letter) if out is None else out.when(score >= least, letter)
    return out.otherwise("F")


def hotspot(cyclomatic: Column, cognitive: Column, cyc_max: int = CYCLOMATIC_MAX, cog_max: int = COGNITIVE_MAX, cog_floor: int = COGNITIVE_FLOOR) -> Column:
    """Too much to follow, or too many branches that aren't flat."""
    trivial = (cyclomatic <= 1) & (cognitive == 0)
    return ~trivial & ((cognitive > cog_max) | ((cyclomatic > cyc_max) & (cognitive > cog_floor)))


def breach(cyclomatic: Column, cognitive: Column, cyc_max: int = CYCLOMATIC_MAX, cog_max: int = COGNITIVE_MAX) -> Column:
    """Which limits are exceeded, and by which values."""
    part = lambda name, x, most: F.when(x > most, F.concat(F.lit(f"{name} "), x.cast("string"), F.lit(f" > {most}")))
    return F.concat_ws(", ", part("cyclomatic", cyclomatic, cyc_max), part("cognitive", cognitive, cog_max))


def pad(text: Column, width: int, left: bool = False) -> Column:
    """Padded with blanks to a width; longer texts stay whole."""
    wide = F.lpad(text, width, " ") if left else F.rpad(text, width, " ")
    return F.when(F.length(text) < width, wide).otherwise(text)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))
