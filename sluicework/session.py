"""Session helpers: reading tables, spreading rows over tasks, cutting lineage in the shared folder, checking broadcast sizes."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow side that may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows (files, manifests) that one task of row-at-a-time Python takes at most, and at least before they are cut finer.
TASK_ROWS, TASK_LEAST = 4_000, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame, name: str = "place") -> DataFrame:
    """df with each row's place in its table: file and row for tables that are read from files, else the order of partitions."""
    try:
        return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())


def _shared(df: DataFrame) -> str:
    """The folder of checkpoints: what spark.checkpoint.dir names.

    A plain local session without that setting gets a temporary folder; on a cluster the setting is needed.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sluicework-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df without its lineage, by a checkpoint in the shared folder."""
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read from there, so that readers take only the columns they need."""
    at = f"{_shared(df)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(rows: DataFrame, key: str, most: int = TASK_ROWS) -> DataFrame:
    """rows in partitions of at most some ``most`` rows, and as many as there are cores.

    A table of one file, or of few row groups, is read by as few tasks, however long each row takes. Rows are counted by
    partition, which reads no column, and sent elsewhere only if a partition holds too many.
    """
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    each = min(most, max(TASK_LEAST, math.ceil(sum(held) / rows.sparkSession.sparkContext.defaultParallelism)))
    return rows.repartition(math.ceil(sum(held) / each), key) if max(held, default=0) > 1.5 * each else rows


def small_enough(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """side with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
