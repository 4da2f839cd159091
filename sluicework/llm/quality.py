"""Quality rules by a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed to a fixed number of buckets. One multinomial over the buckets is counted on trusted
target texts, the other on the whole raw corpus. A text's score is the mean over its n-grams of the log ratio of the two,
drawn towards 0 for very short texts, and every text is kept or rejected by one threshold on it. The threshold follows
from trusted texts that are held out of the target's counts, so it means the same at any size of the corpus.

Counting is one scan whose tasks each give up one sketch of fixed size; the sketches are summed by parts. Scoring is a
second scan, with the ratios as a broadcast of fixed size. Neither moves texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_enough, through_arrow

BITS = 16
ORDERS = (1, 2)
#: Share of the raw distribution in the target's: an n-gram that no trusted text has is half as likely there at least.
BLEND = 0.5
#: N-grams of log ratio 0 that are added to every text.
SHRINK = 10
#: One in so many trusted texts is held out.
HOLD_OUT = 5
#: The threshold lies below the held-out scores' first percentile, by this part of its distance to their median.
MARGIN = 0.5
#: Trusted texts that define the target, those with the smallest id hashes.
TRUSTED = 20_000
_PARTS = 16


def buckets(body: np.ndarray, at: np.ndarray, orders=ORDERS, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of all n-grams of the lower-cased texts, by order. Words are runs without blanks."""
    words = K.Words(body, at, _WORD_BYTE)
    for n in orders:
        g, count = K.grams(words, n)
        yield (g >> np.uint64(64 - bits)).astype(np.int64), np.repeat(np.arange(len(at) - 1), count)


#: Punctuation belongs to words here: how a text is written is what the ratio is to see.
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[*b" \t\r\n\f\v\0"]] = False

_SKETCH = pa.schema([("part", pa.int32()), ("block", pa.binary())])


def _count(orders, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, some = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), False
        for batch in batches:
            body, at = K.texts(batch.column(0))
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            some |= batch.num_rows > 0
            for i, j in K.slices(at):
                for b, row in buckets(body[at[i] : at[j]], at[i : j + 1] - at[i], orders, bits):
                    raw += np.bincount(b, minlength=1 << bits)
                    target += np.bincount(b[trusted[i:j][row]], minlength=1 << bits)
        if some:
            blocks = [K.pack(a, b) for a, b in zip(raw.reshape(_PARTS, -1), target.reshape(_PARTS, -1))]
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(blocks, pa.binary())], schema=_SKETCH)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = K.unpack(block, "i8", "i8")
            total[part] = [a + b for a, b in zip(total[part], got)] if part in total else got
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([K.pack(*x) for x in total.values()], pa.binary())], schema=_SKETCH)


class Model:
    """Log ratio of target to raw probability by bucket, and the threshold."""

    def __init__(self, ratios: np.ndarray, threshold: float):
        self.ratios, self.threshold = ratios, threshold


def ratios_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratios from the counts by bucket; all 0 without a target."""
    if not target.sum():
        return np.zeros(len(raw))
    base = (raw + 1) / (raw.sum() + len(raw))
    return np.log((1 - BLEND) * target / target.sum() / base + BLEND)


def threshold_of(scores: np.ndarray) -> float:
    """The threshold for held-out scores; minus infinity without any, so that all texts with an n-gram are kept."""
    if not len(scores):
        return -np.inf
    low, middle = np.quantile(scores, (0.01, 0.5))
    return float(np.round(low - MARGIN * (middle - low), 6))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders=ORDERS, bits: int = BITS, most: int = TRUSTED) -> Model:
    """A model from all of docs and from the texts of the ids in trusted.

    Trusted ids beyond ``most`` are left out by hash. Null ids and texts count as raw only.
    """
    spark = docs.sparkSession
    ids = trusted.select(F.col(id_col).cast("long").alias("__trusted")).where("__trusted is not null").distinct().orderBy(F.xxhash64("__trusted"), "__trusted").limit(most)
    ids = ids.withColumn("__held", F.pmod(F.xxhash64("__trusted", F.lit(1)), F.lit(HOLD_OUT)) == 0)
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    marked = src.join(small_enough(ids, most), F.col("__id") == F.col("__trusted"), "left")
    sketches = marked.select("__text", F.coalesce(~F.col("__held"), F.lit(False))).mapInArrow(K.thrifty(_count(orders, bits)), "part int, block binary")
    raw, target = np.zeros((_PARTS, (1 << bits) // _PARTS)), np.zeros((_PARTS, (1 << bits) // _PARTS))
    for r in sketches.repartition(_PARTS, "part").mapInArrow(K.thrifty(_add), "part int, block binary").collect():
        raw[r.part], target[r.part] = K.unpack(bytes(r.block), "i8", "i8")
    ratios = ratios_of(raw.ravel(), target.ravel())
    held = src.join(small_enough(ids.where("__held").drop("__held"), most), F.col("__id") == F.col("__trusted")).select("__text")
    scores = score_quality(held, Model(ratios, 0.0), "__text", orders, bits, keep=[]).where("n_grams > 0").select("score").collect()
    return Model(ratios, threshold_of(np.array([r.score for r in scores])))


def _score(shared, orders, bits: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            body, at = K.texts(batch.column(0))
            for i, j in K.slices(at):
                total, number = np.zeros(j - i), np.zeros(j - i, np.int64)
                for b, row in buckets(body[at[i] : at[j]], at[i : j + 1] - at[i], orders, bits):
                    total += np.bincount(row, weights=ratio[b], minlength=j - i)
                    number += np.bincount(row, minlength=j - i)
                score = np.round(total / (number + SHRINK), 6)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own.columns[1:], pa.array(number), pa.array(score), pa.array((score >= threshold) & (number > 0))], names=[*own.schema.names[1:], "n_grams", "score", "keep"])

    return run


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", orders=ORDERS, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with ``n_grams``, ``score`` and the decision ``keep``.

    ``score`` is the mean log ratio of a text's n-grams, of which SHRINK count as 0; a text of one word has one
    unigram and one short bigram. A null, empty or blank text has no n-gram and score 0 and isn't kept. Texts of any
    length are read whole. Columns of docs with one of the three names are replaced; the others stay, as do repeated
    rows. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.ratios)
    return through_arrow(docs, text_col, keep, _score(shared, orders, bits, model.threshold), "n_grams bigint, score double, keep boolean")
