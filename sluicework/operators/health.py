"""Complexity metrics, hotspots and the health score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import BUDGET, PENALTY_CAP, breach, grade, hotspot

TOP = 20


def metrics(units: DataFrame, points: DataFrame, key: list[str], nested: str = "nested", depth: str = "depth", cyc: str = "cyc", cog: str = "cog") -> DataFrame:
    """units with ``cyclomatic`` and ``cognitive`` from their decision points; units without any have 1 and 0."""
    cost = F.when(F.col(cog) == 0, 0).when(F.col(nested), 1 + F.col(depth)).otherwise(1)
    sums = points.groupBy(*key).agg(F.sum(cyc).alias("__cyc"), F.sum(cost).alias("__cog"))
    out = units.join(sums, key, "left")
    return out.withColumn("cyclomatic", (F.coalesce("__cyc", F.lit(0)) + 1).cast("int")).withColumn("cognitive", F.coalesce("__cog", F.lit(0)).cast("int")).drop("__cyc", "__cog")


def hotspots(rows: DataFrame, **limits) -> DataFrame:
    cyc, cog = F.col("cyclomatic"), F.col("cognitive")
    shown = {k: v for k, v in limits.items() if k != "cog_floor"}
    return rows.where(hotspot(cyc, cog, **limits)).withColumn("breach", breach(cyc, cog, **shown))


def health(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(score, grade, n): 100 less the mean penalty; the penalty is the magnitude above a budget, capped.

    The magnitude is the greater of the two metrics. No rows at all give 100 and A.
    """
    magnitude = F.greatest("cyclomatic", "cognitive")
    penalty = F.least(F.greatest(magnitude - BUDGET, F.lit(0)), F.lit(PENALTY_CAP))
    out = rows.groupBy(*(by or [])).agg(F.sum(penalty).alias("__p"), F.count("*").alias("n"))
    share = F.coalesce(F.col("__p") / (F.col("n") * PENALTY_CAP), F.lit(0.0))
    score = F.least(F.greatest(F.round(100 * (1 - share)), F.lit(0)), F.lit(100)).cast("int")
    return out.withColumn("score", score).withColumn("grade", grade(F.col("score"))).drop("__p")


def worst(rows: DataFrame, top: int = TOP, order: tuple[str, ...] = ("file_path", "line", "qualified_name")) -> DataFrame:
    """The top rows by magnitude; ties by the given columns."""
    return rows.withColumn("magnitude", F.greatest("cyclomatic", "cognitive")).orderBy(F.desc("magnitude"), *order).limit(top)
