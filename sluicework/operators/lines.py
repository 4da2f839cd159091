"""Line tables, occurrence numbers and neighbours in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line_no, line): the pieces between newlines, numbered from 1."""
    return rows.select(*key, F.posexplode(F.split(text, "\n", -1)).alias("__i", "line")).select(*key, (F.col("__i") + 1).alias("line_no"), "line")


def with_previous(rows: DataFrame, key: list[str], order: str, test: Column, name: str = "previous") -> DataFrame:
    """rows with ``name``: whether the test holds for the row before; false for a first row."""
    before = F.lag(test).over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn(name, F.coalesce(before, F.lit(False)))


def with_occurrence(rows: DataFrame, key: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """rows with a number from 0 among the rows of the same key, in the given order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def outside(inner: DataFrame, outer: DataFrame, key: list[str], pre: str, post: str) -> DataFrame:
    """inner without the rows that lie within an outer interval of the same key."""
    o = outer.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(pre).alias("__pre"), F.col(post).alias("__post"))
    within = (F.col("__pre") < F.col(pre)) & (F.col("__post") > F.col(post))
    for k in key:
        within &= F.col(f"__{k}") == F.col(k)
    return inner.join(o, within, "left_anti")


def last_by(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """By key, the values of the last row in order."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last")).select(*key, "__last.*")
