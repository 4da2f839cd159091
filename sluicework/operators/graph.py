"""Graph kernels on edge tables: strongly connected components and reachability.

Rounds are cut by checkpoints; the driver only sees counts. What is left of a graph goes to one task as soon as it has no
more edges than SMALL_EDGES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import settle

#: Edges that one task may hold: some 100 MB.
SMALL_EDGES = 1_000_000


def clean_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst) without nulls and self-loops."""
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()


def _trim(edges: DataFrame) -> DataFrame:
    """Edges whose source is reached and whose target leads on; a single round."""
    into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Every node's smallest colour among the nodes that reach it. colour: (node, c)."""
    total = colour.agg(F.sum(F.xxhash64("node", "c").cast("decimal(38,0)"))).first()[0]
    while True:
        sent = edges.join(colour, edges["src"] == colour["node"]).select(F.col("dst").alias("node"), "c")
        colour = settle(colour.unionByName(sent).groupBy("node").agg(F.min("c").alias("c")))
        now = colour.agg(F.sum(F.xxhash64("node", "c").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return colour
        total = now


def strong(start: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The number of each node's strongly connected component; node v's edges go to target[start[v]:start[v + 1]].

    Depth first without recursion: a component is complete when its first node's search ends without having reached back.
    """
    n = len(start) - 1
    begin, goals = start.tolist(), target.tolist()
    number, low, group = [0] * n, [0] * n, [-1] * n
    seen, found, open_, path, edge = 0, 0, [], [], begin[:n]
    for root in range(n):
        if number[root]:
            continue
        path.append(root)
        while path:
            v = path[-1]
            if not number[v]:
                seen += 1
                number[v] = low[v] = seen
                open_.append(v)
            if edge[v] < begin[v + 1]:
                w = goals[edge[v]]
                edge[v] += 1
                if not number[w]:
                    path.append(w)
                elif group[w] < 0 and number[w] < low[v]:
                    low[v] = number[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == number[v]:
                while group[v] < 0:
                    group[open_.pop()] = found
                found += 1
    return np.array(group, np.int64)


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all components of two or more nodes."""
    held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if held is None or not held.num_rows:
        return
    both = pa.chunked_array([*held.column(0).chunks, *held.column(1).chunks]).combine_chunks().dictionary_encode()
    names, code = both.dictionary, both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    src, dst = code[: held.num_rows], code[held.num_rows :]
    order = np.argsort(src, kind="stable")
    group = strong(np.searchsorted(src[order], np.arange(len(names) + 1)), dst[order])
    place = np.empty(len(names), np.int64)
    place[pa.compute.sort_indices(names).to_numpy()] = np.arange(len(names))
    first = np.full(int(group.max()) + 1, len(names))
    np.minimum.at(first, group, place)
    by_place = np.argsort(place)
    inside = np.flatnonzero(np.bincount(group)[group] > 1)
    yield pa.RecordBatch.from_arrays([names.take(pa.array(inside)), names.take(pa.array(by_place[first[group[inside]]]))], names=["node", "root"])


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root): the strongly connected components of two or more nodes, each named by its smallest node.

    Rounds of colouring: the smallest node that reaches a node is its colour; inside a colour, what reaches the colour's
    own node is one component. Found components and nodes that lie on no cycle are dropped before the next round.
    """
    left, found = settle(_trim(clean_edges(edges, src, dst))), None
    kind = left.schema[0].dataType
    while (size := left.limit(SMALL_EDGES + 1).count()) > 0:
        if size <= SMALL_EDGES:
            rest = left.repartition(1).mapInArrow(_one_task, StructType([StructField("node", kind), StructField("root", kind)]))
            return rest if found is None else found.unionByName(rest)
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _spread(left, nodes.withColumn("c", F.col("node")))
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
        inside = settle(left.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("c")))
        # backwards from each colour's own node
        reached = settle(colour.where("node = c"))
        fresh = reached
        while True:
            step = inside.join(fresh.select(F.col("node").alias("dst"), F.col("c").alias("fc")), "dst").where("c = fc").select(F.col("src").alias("node"), "c").distinct()
            fresh = settle(step.join(reached, ["node", "c"], "left_anti"))
            if fresh.isEmpty():
                break
            reached = settle(reached.unionByName(fresh))
        big = reached.groupBy("c").count().where("count >= 2").select("c")
        group = settle(reached.join(big, "c", "left_semi").select("node", F.col("c").alias("root")))
        found = group if found is None else settle(found.unionByName(group))
        gone = reached.select("node")
        left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = settle(_trim(left.select("src", "dst")))
    if found is None:
        return edges.sparkSession.createDataFrame([], StructType([StructField("node", kind), StructField("root", kind)]))
    return found


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(root, members, n, kind): one row per component; two members make a bidirectional cycle."""
    out = components(edges, src, dst).groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count("*").alias("n"))
    return out.withColumn("kind", F.when(F.col("n") == 2, "bidirectional-cycle").otherwise("multi-file-cycle"))


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All (src, dst) with a path from src to dst, by semi-naive rounds that join what is new with itself."""
    step = settle(clean_edges(edges, src, dst))
    total = new = step
    while True:
        more = new.join(total.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        more = more.unionByName(total.join(new.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")))
        new = settle(more.distinct().join(total, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return total
        total = settle(total.unionByName(new))
