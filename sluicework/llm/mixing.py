"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a in [0, 1] and normalised. The exponent is bisected so that the weights
reach a target entropy without any source being repeated more often than a limit. The weights are realised as integer
token budgets; a source fills its budget with whole epochs, each a permutation of its documents by a keyed hash, and the
first documents of one more permutation. Blocks cut every source's stream into equal shares, so that each block of the
mixture has the weights of the whole.

Documents are read once for their token counts, and the mixture is made of ids and counts. Only the table that is to be
mixed itself moves its texts, to the partitions of their blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, BROADCAST_ROWS, column, input_bytes, partitions, save, small_enough

#: Target entropy as a part of the greatest that the sources allow.
TARGET_ENTROPY = 0.9
MAX_EPOCHS = 4.0
#: Tokens of one block of the mixture; there is one block at least.
BLOCK_TOKENS = 1_000_000
#: Sources of a mixture, whose token counts the driver holds; more are an error.
MAX_SOURCES = 1_000_000
#: Bytes of text that a task of the mixed table is meant to hold.
TASK_BYTES = 128 << 20
SEED = 17
STEPS = 60
_UNIT = 1_000_000_000
#: A token here is a run of characters other than these blanks.
TOKEN = "[^ \\t\\r\\n]+"


def temperature_weights(tokens: dict, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None) -> tuple[float, dict]:
    """(exponent, weights in billionths) for token counts by source.

    The exponent is the greatest in [0, 1] whose weights reach the target entropy; if a source would then be repeated
    more than ``max_epochs`` times within the budget, it is the least that keeps to this limit. Sources without tokens
    have weight 0. An exponent of 1 keeps the shares; it is also the answer where no other meets the limit.
    """
    live = {s: n for s, n in sorted(tokens.items()) if n > 0}
    total = sum(live.values())
    if not live:
        return 1.0, {s: 0 for s in tokens}
    budget = total if budget is None else budget
    share = {s: n / total for s, n in live.items()}

    def weights(a: float) -> dict:
        p = {s: x**a for s, x in share.items()}
        z = math.fsum(p.values())
        return {s: x / z for s, x in p.items()}

    def entropy(a: float) -> float:
        return -math.fsum(w * math.log(w) for w in weights(a).values())

    def epochs(a: float) -> float:
        return max(w * budget / live[s] for s, w in weights(a).items())

    def bisect(good) -> float:
        """The greatest exponent with good(a), which holds from 0 up to some point."""
        if good(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    a = bisect(lambda a: entropy(a) >= target_entropy * math.log(len(live)) - 1e-12)
    if epochs(a) > max_epochs:
        # the limit holds from an exponent of 1 downwards
        a = 1.0 - bisect(lambda b: epochs(1.0 - b) <= max_epochs) if epochs(1.0) <= max_epochs else 1.0
    w = weights(a)
    return a, {s: round(w[s] * _UNIT) if s in w else 0 for s in tokens}


def _key(id_: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def _source(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, tokens) of every row, saved."""
    own = [column(docs, n) for n in (id_col, source_col, text_col)]
    return save(docs.select(own[0].alias("id"), _source(own[1]).alias("source"), _tokens(own[2]).alias("tokens")), "mixing-counts")


def _plan(counted: DataFrame, target_entropy: float, max_epochs: float, budget: int | None) -> tuple[int, Callable[..., DataFrame]]:
    """The sum of all budgets, and columns by source: its tokens, weight, token budget, whole epochs and what is left of the budget."""
    spark = counted.sparkSession
    # one row for each source of the mixture: this is the mixture's own description
    totals = {r.source: r.tokens for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    _, weight = temperature_weights(totals, target_entropy, max_epochs, budget)
    whole = sum(totals.values()) if budget is None else budget
    rows = []
    for s, n in sorted(totals.items()):
        own = (whole * weight[s] + _UNIT // 2) // _UNIT
        rows.append((s, n, weight[s], own, own // n if n else 0, own % n if n else 0))
    plan = spark.createDataFrame(rows, "source string, total long, weight long, budget long, whole long, rest long")
    hint = F.broadcast if len(rows) <= BROADCAST_ROWS // 10 else lambda side: side
    return sum(r[3] for r in rows), lambda *names: hint(plan.select("source", *names))


def _running(rows: DataFrame) -> DataFrame:
    """rows (source, epoch, key, tokens, id, ...) with ``before``: the tokens of the same source and epoch in front.

    Rows are ordered by key within slices of the key's range, whose totals are summed up first: no window holds more than
    a 4096th of a source.
    """
    rows = rows.withColumn("slice", F.substring("key", 1, 3))
    ahead = Window.partitionBy("source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("source", "epoch", "slice").agg(F.sum("tokens").alias("t")).withColumn("ahead", F.coalesce(F.sum("t").over(ahead), F.lit(0))).drop("t")
    inside = Window.partitionBy("source", "epoch", "slice").orderBy("key", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return rows.join(slices, ["source", "epoch", "slice"]).withColumn("before", F.col("ahead") + F.col("inside")).drop("slice", "ahead", "inside")


def _partial(counted: DataFrame, plan: Callable[..., DataFrame], seed: int) -> DataFrame:
    """Rows of each source's unfinished epoch that begin within what is left of its budget."""
    rows = counted.join(plan("whole", "rest"), "source").where("rest > 0")
    rows = rows.select("source", F.col("whole").alias("epoch"), "id", "tokens", "rest", _key(F.col("id"), F.col("whole"), seed).alias("key"))
    return _running(rows).where("before < rest")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, tokens, epoch, block, place): the mixture, one row for each copy of a document.

    ``epoch`` counts the copies of a document from 0. ``block`` is the part of the mixture that the copy lies in, by the
    tokens in front of it in its source's stream, and ``place`` its position in the block, a permutation by hash. The
    budget in tokens is the table's own total unless given.

    A null source is the source ''. A null or empty text has no tokens: it goes with its source's epochs. Null ids take
    part. Repeated rows are copies with the same hash and stay together. Texts of any length count whole; a document is
    in if it begins within the budget, so a source may exceed it by less than one document. An empty table gives no rows.
    Other columns of docs are not read.
    """
    counted = _counted(docs, id_col, text_col, source_col)
    whole, plan = _plan(counted, target_entropy, max_epochs, budget)
    full = counted.join(plan("whole"), "source").where("whole > 0")
    full = full.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), "id", "tokens")
    full = _running(full.withColumn("key", _key(F.col("id"), F.col("epoch"), seed)))
    part = _partial(counted, plan, seed).drop("rest")
    rows = full.unionByName(part).join(plan("total", "budget"), "source")
    blocks = max(1, -(-whole // block_tokens))
    at = F.col("epoch") * F.col("total") + F.col("before")
    block = F.least(F.when(F.col("budget") > 0, F.floor(at.cast("decimal(38,0)") * blocks / F.col("budget"))).otherwise(0), F.lit(blocks - 1)).cast("long")
    rows = rows.withColumn("block", block)
    order = Window.partitionBy("block").orderBy("key", "source", "id", "epoch", "tokens")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select(F.col("id").alias("doc_id"), "source", "tokens", "epoch", "block", "place")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with its rows repeated, left out and permuted as `mix_sources` has it; the columns stay as they are.

    Rows come out block by block, each block's in its places, in partitions of whole blocks. Repeated rows (equal id, source
    and tokens) are taken together, in the place of the first. Null ids, null or empty texts and null sources take part
    as in `mix_sources`; texts of any length are whole; an empty table stays empty.
    """
    spark = docs.sparkSession
    rows = mix_sources(docs, id_col, text_col, source_col, **how)
    own = rows.groupBy("doc_id", "source", "tokens", "epoch").agg(F.min(F.struct("block", "place")).alias("at"))
    own = own.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("tokens").alias("__tokens")).agg(F.collect_list("at").alias("__at"))
    own = save(own, "mixing-places")
    blocks = (own.agg(F.max(F.array_max("__at.block"))).first()[0] or 0) + 1
    parts = min(blocks, max(partitions(spark), -(-input_bytes(docs) * 4 // TASK_BYTES)))
    same = column(docs, id_col).eqNullSafe(F.col("__id")) & (_source(column(docs, source_col)) == F.col("__source")) & (_tokens(column(docs, text_col)) == F.col("__tokens"))
    out = docs.join(small_enough(own, most_bytes=BROADCAST_BYTES), same).select(*[column(docs, n).alias(f"d{k}") for k, n in enumerate(docs.columns)], F.explode("__at").alias("__a"))
    out = out.repartitionById(parts, F.floor(F.col("__a.block") * parts / blocks).cast("int")).sortWithinPartitions("__a.block", "__a.place")
    return out.select(*[F.col(f"d{k}").alias(n) for k, n in enumerate(docs.columns)])
