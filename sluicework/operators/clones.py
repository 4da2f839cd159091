"""Clone clusters: groups of equal (renamed) sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

MIN_TOKENS, MIN_DISTINCT = 50, 8
#: Tokens that are numbered at once: some 60 MB. A longer block is a slice of its own.
SLICE = 400_000


def exact_clusters(rows: DataFrame, content: Column, location: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """(digest, n, locations, ...) of contents that occur twice or more; locations are sorted.

    Grouping is on a 256-bit digest, so the shuffle carries no contents.
    """
    found = rows.where(content.isNotNull()).groupBy(F.sha2(content, 256).alias("digest"))
    aggs = [F.count("*").alias("n"), F.sort_array(F.collect_list(location)).alias("locations"), *[c.alias(n) for n, c in (extra or {}).items()]]
    return found.agg(*aggs).where("n >= 2")


def split_kind(item: str) -> tuple[str, str]:
    """(kind, lexeme) of a token that is written as its kind, U+0001 and its lexeme."""
    kind, _, lexeme = item.partition("\x01")
    return kind, lexeme


def _normal(blocks: int, kind_of: Callable[[str], tuple[str, str]], slotted: tuple[str, ...], min_distinct: int):
    """Batches of (items, block columns) to (block columns, token_count, digest), all tokens of a slice at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            lists = batch.column(0)
            code = lists.flatten().dictionary_encode()
            words = [kind_of(w) for w in code.dictionary.to_pylist()]
            code, n = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words))
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            kind = np.array([slotted.index(k) if k in slotted else -1 for k, _ in words], np.int64)
            # the different tokens of each row, with their first places; of a slotted kind they are numbered by these
            key, first, at = np.unique(row * n + code, return_index=True, return_inverse=True)
            own, what = key // n, key % n
            order = np.lexsort((first, kind[what], own))
            group = own[order] * (len(slotted) + 1) + kind[what[order]]
            new = np.ones(len(group), bool)
            new[1:] = group[1:] != group[:-1]
            slot = np.empty(len(key), np.int64)
            slot[order] = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else 0
            text = np.array([words[w][1] if kind[w] < 0 else f"\x01{words[w][0]}{s}" for w, s in zip(what.tolist(), slot.tolist())], object)[at]
            end = np.cumsum(size)
            keep = np.flatnonzero(np.bincount(own, minlength=len(size)) >= min_distinct)
            digest = [hashlib.sha256("\x1f".join(text[end[r] - size[r] : end[r]]).encode("utf-8", "surrogatepass")).hexdigest() for r in keep]
            kept = [c.take(pa.array(keep)) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(size[keep].astype(np.int32)), pa.array(digest, pa.string())], names=[*(f"b{k}" for k in range(blocks)), "token_count", "digest"])

    return run


def slices(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists, in its first column, have at most SLICE items together."""
    size = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
    start, held, most = 0, 0, most or SLICE
    for k, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def renamed_clusters(rows: DataFrame, block: list[str], items: str = "items", kind_of: Callable[[str], tuple[str, str]] = split_kind, slotted: tuple[str, ...] = ("id", "lit"), min_tokens: int = MIN_TOKENS, min_distinct: int = MIN_DISTINCT) -> DataFrame:
    """(digest, token_count, blocks) of blocks that are equal but for a consistent renaming. One row is one block.

    items: the block's tokens in order; kind_of gives a token's kind and lexeme, once for all equal ones. Tokens of a slotted kind are numbered by
    their first place in the block, each kind on its own; the others stand for themselves. Blocks of too few tokens or
    too few different ones are left out. Tokens are numbered where the block lies: only a digest a block is shuffled.
    """
    src = rows.where(F.size(items) >= max(1, min_tokens)).select(items, *[F.col(b).alias(f"b{k}") for k, b in enumerate(block)])
    schema = StructType([*(StructField(f.name, f.dataType) for f in src.schema.fields[1:]), StructField("token_count", IntegerType()), StructField("digest", StringType())])
    whole = src.mapInArrow(_normal(len(block), kind_of, slotted, min_distinct), schema)
    at = F.struct(*[F.col(f"b{k}").alias(b) for k, b in enumerate(block)])
    return whole.groupBy("digest", "token_count").agg(F.sort_array(F.collect_list(at)).alias("blocks")).where(F.size("blocks") >= 2)
