"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import kernels as K

#: Rows of a (bigint, small payload) side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of a saved side with lists or strings that may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """The column of df with exactly this name, whatever characters are in it."""
    return df[f"`{name.replace('`', '``')}`"]


def through_arrow(docs: DataFrame, text_col: str, keep: list[str] | None, run, new: str) -> DataFrame:
    """The columns ``keep`` of docs (all if None) and the columns ``new`` (a schema) that run makes.

    run gets batches of the text and the kept columns and gives the kept and the new ones. The kept columns go through
    under names of their own and with their types as they are. Those whose names, in any case, are new are replaced.
    """
    added = StructType.fromDDL(new)
    gone = {n.lower() for n in added.names}
    names = [n for n in (docs.columns if keep is None else keep) if n.lower() not in gone]
    src = docs.select(column(docs, text_col).alias("__text"), *[column(docs, n).alias(f"c{k}") for k, n in enumerate(names)])
    kept = [StructField(f.name, f.dataType) for f in src.schema.fields[1:]]
    out = src.mapInArrow(K.thrifty(run), StructType([*kept, *added.fields]))
    return out.select(*[out[f"c{k}"].alias(n) for k, n in enumerate(names)], *[out[n] for n in added.names])


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the cluster asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _add_chunks(pdf):
    total = sum(K.unpack(b, "i8")[0] for b in pdf["block"])
    return pdf.iloc[:1][["chunk"]].assign(block=[K.pack(total)])


def summed_sketch(rows: DataFrame, bits: int, chunks: int) -> np.ndarray:
    """The sum of count sketches of 2^bits buckets, which the tasks give as chunks (chunk, block)."""
    count = np.zeros((chunks, (1 << bits) // chunks), np.int64)
    for r in rows.where("chunk is not null").select("chunk", "block").groupBy("chunk").applyInPandas(_add_chunks, "chunk int, block binary").collect():
        count[r.chunk] = K.unpack(bytes(r.block), "i8")[0]
    return count.ravel()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is read from, as far as they are known; it only sizes partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a plain local session may fall back to a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="sluicework-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def save(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it: the lineage ends there.

    The files outlive any executor and are deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(side: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int | None = None) -> DataFrame:
    """side with a broadcast hint where its counted rows allow it, else as it is (a shuffled join).

    most_bytes: what the files of a saved side may have too, where its rows have no fixed width.
    """
    fits = (most_bytes is None or input_bytes(side) <= most_bytes) and side.limit(rows + 1).count() <= rows
    return F.broadcast(side) if fits else side
