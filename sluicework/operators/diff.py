"""Baseline difference and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def baseline_diff(current: DataFrame, base: DataFrame, key: str = "fingerprint") -> DataFrame:
    """All rows of both with ``status``: current rows are new or kept, baseline rows without a match are fixed.

    Keys may repeat: every current row with a known key is kept. Both sides are shuffled by key once and sorted there, so
    that no task holds the keys of what it reads; a key's rows may spill.
    """
    cols = [c for c in current.columns if c in base.columns]
    both = current.select(*cols, F.lit(False).alias("__old")).unionByName(base.select(*cols, F.lit(True).alias("__old")))
    group = Window.partitionBy(key)
    met = F.col(key).isNotNull() & (F.max("__old").over(group) != F.min("__old").over(group))
    rows = both.withColumn("__met", met).where(~(F.col("__old") & F.col("__met")))
    return rows.select(*cols, F.when(F.col("__old"), "fixed").when(F.col("__met"), "kept").otherwise("new").alias("status"))


def ratchet(diff: DataFrame) -> DataFrame:
    """One row: counts by status and whether the gate passes, which it does without new findings."""
    n = lambda s: F.count_if(F.col("status") == s)
    return diff.agg(n("new").alias("new_count"), n("kept").alias("kept_count"), n("fixed").alias("fixed_count")).withColumn("passed", F.col("new_count") == 0)


def absolute(findings: DataFrame, threshold: int = 0) -> DataFrame:
    return findings.agg(F.count("*").alias("total")).withColumn("passed", F.col("total") <= threshold)


def band_anti(findings: DataFrame, directives: DataFrame, keys: list[str], line: str = "line", reach: int = 1) -> DataFrame:
    """findings without those that a directive with equal keys covers: on its line or up to ``reach`` lines below.

    Each directive becomes one row per covered line, so the join is an equi-join and needs no range condition.
    """
    cover = directives.select(*keys, F.explode(F.sequence(F.col(line), F.col(line) + reach)).alias(line)).distinct()
    return findings.join(cover, [*keys, line], "left_anti")


def unused(candidates: DataFrame, *references: DataFrame, key: str) -> DataFrame:
    """Candidates that no reference names."""
    for r in references:
        candidates = candidates.join(r.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return candidates
