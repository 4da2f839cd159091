"""Line deduplication within an edit distance of one, by a deletion-neighbourhood join; short lines go when equal.

Every line emits the hashes of all strings that one deletion makes of it, and its own; two lines within the bound share
one. Equal variants are joined, the pairs are verified by edit distance, and the earliest line is kept.

A line of L characters has L + 1 variants, so a lossless filter first finds the lines that can have a partner. Cut a
line into three blocks: one edit leaves two of them as they are, and changes the parities of the third one's
characters (hashed to 16 bits) in two places at most. Lines with no equal two-block key and nearby parity have no
neighbour and emit no variants. Keys and variants travel as packed blocks. Keys are counted in a sketch of fixed size first:
the lines of a frequent one are cut into blocks, every two of which meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import column, input_bytes, partitions, save, small_enough, summed_sketch

#: Lines of fewer characters (after trimming) have no near matches, one edit makes another word of them: only equal ones go.
MIN_CHARS = 20
#: Bytes of packed keys that a task is meant to hold; they are about as many as the bytes of text.
TASK_BYTES = 48 << 20
_KEY_BYTES = 14
BLOCKS = 3
#: Lines of a key that meet in one task: two blocks of this many at most.
KEY_BLOCK = 100_000
SKETCH_BITS = 20
_CHUNKS = 64
_FLUSH = 1_500_000
_TRIM = " \t\r"
_BITS = np.concatenate(([0], 1 << np.arange(16))).astype(np.uint16)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _flush(key: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    part = ((key >> np.uint64(34)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    low = (key & np.uint64(0xFFFFFFFF)).astype("u4")
    out = [(p, K.pack(low[o], *(c[o] for c in columns))) for p in range(parts) if len(o := order[edge[p] : edge[p + 1]])]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["part", "block"])


class Lines:
    """The lines of some text, trimmed and of at least min_chars characters: code points, starts, ends and prefix sums."""

    def __init__(self, text: str, min_chars: int):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        cut = np.flatnonzero(code == 10)
        start, end = np.concatenate(([0], cut + 1)), np.append(cut, n)
        solid = np.flatnonzero((code != 32) & (code != 9) & (code != 13) & (code != 10))
        low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
        some = low < high
        first, last = solid[low[some]], solid[high[some] - 1] + 1
        long = last - first >= min_chars
        self.first, self.last = first[long], last[long]
        self.up, self.down = K.powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        self.parity = np.zeros(n + 1, np.uint16)
        with np.errstate(over="ignore"):
            np.cumsum((K.mix(code.astype(np.uint64) + np.uint64(1)) | np.uint64(1)) * self.up[:n], out=self.total[1:])
            bit = np.left_shift(1, (code * np.uint32(2654435761)) >> np.uint32(28)).astype(np.uint16)
        np.bitwise_xor.accumulate(bit, out=self.parity[1:])

    def keys(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, parity) of all lines for each block left out, as the shorter or equal and as the longer of two lines."""
        first, last, total = self.first, self.last, self.total
        for extra in (0, 1):
            size = last - first - extra
            for j in range(BLOCKS):
                a, b = first + j * size // BLOCKS, first + (j + 1) * size // BLOCKS + extra
                with np.errstate(over="ignore"):
                    rest = ((total[a] - total[first]) + (total[last] - total[b]) * self.down[b - a]) * self.down[first]
                    key = K.mix(K.mix(rest) + (size * BLOCKS + j).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                yield key, self.parity[b] ^ self.parity[a]


def _pieces(texts: list[str], most: int = K.SLICE) -> Iterator[str]:
    """Texts joined to about `most` characters: a text's end is a line's end."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield "\n".join(held)
            held, size = [], 0
    if held:
        yield "\n".join(held)


_HIGH = np.uint64(64 - SKETCH_BITS)


def _filter_keys(min_chars: int):
    """Blocks of (key, parity, line) of each task's different lines, and its part of the sketch of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, sketch = [], 0, np.zeros(1 << SKETCH_BITS, np.int64)

        def flush() -> pa.RecordBatch:
            k, p, h = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((h, k))
            k, p, h = k[order], p[order], h[order]
            new = _runs(k, h)
            k, p, h = k[new], p[new], h[new]
            np.add(sketch, np.bincount((k >> _HIGH).astype(np.int64), minlength=len(sketch)), out=sketch)
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([K.pack(k, p, h)], pa.binary())], names=["chunk", "block"])

        for batch in batches:
            for text in _pieces(batch.column(0).to_pylist()):
                lines = Lines(text, min_chars)
                own = np.array([xxhash.xxh64_intdigest(text[a:b].encode(), seed=42) for a, b in zip(lines.first.tolist(), lines.last.tolist())], np.uint64)
                for key, parity in lines.keys():
                    held.append((key, parity, own))
                    size += len(own)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        if sketch.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([K.pack(c) for c in sketch.reshape(_CHUNKS, -1)], pa.binary())], names=["chunk", "block"])

    return run


def _route(parts: int, blocks):
    """The keys by part; a line with a frequent key goes to one cell for each block that its own block meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = blocks.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                k, p, h = K.unpack(block, "u8", "u2", "u8")
                split = many[(k >> _HIGH).astype(np.int64)]
                hot = np.flatnonzero(split > 1)
                if len(hot):
                    row, cell, _ = K.cells((K.mix(h[hot]) % split[hot].astype(np.uint64)).astype(np.int64), split[hot])
                    cold, more = split == 1, hot[row]
                    with np.errstate(over="ignore"):
                        k = np.concatenate((k[cold], K.mix(k[more] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
                    p, h = np.concatenate((p[cold], p[more])), np.concatenate((h[cold], h[more]))
                yield _flush(k, parts, p, h)

    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the lines that share a key with another line of nearby parity."""
    blocks = [K.unpack(b, "u4", "u2", "u8") for batch in batches for b in batch.column(1).to_pylist()]
    if not blocks:
        return
    key, parity, own = (np.concatenate([b[k] for b in blocks]) for k in range(3))
    order = np.lexsort((own, key))
    key, parity, own = key[order], parity[order], own[order]
    new = _runs(key, own)
    key, parity, own = key[new], parity[new], own[new]
    same = np.concatenate((key[1:] == key[:-1], [False]))
    keep = same | np.concatenate(([False], same[:-1]))
    key, parity, own = key[keep], parity[keep], own[keep]
    live = []
    for at in _groups(key, 200_000):
        # parities at most two bits apart have a common value at most one bit from each
        wide = (key[at].astype(np.uint64)[:, None] << np.uint64(16)) | (parity[at][:, None] ^ _BITS[None, :])
        who = np.repeat(np.arange(at.start, at.stop), len(_BITS))
        order = np.argsort(wide, axis=None)
        value, who = wide.ravel()[order], who[order]
        same = np.concatenate((value[1:] == value[:-1], [False]))
        live.append(np.unique(own[who[same | np.concatenate(([False], same[:-1]))]]))
    if live:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(live)).view(np.int64))], names=["h"])


def _groups(key: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of the sorted key of about `most` rows that cut no run of equal keys."""
    at = 0
    while at < len(key):
        to = min(len(key), at + most)
        to = int(np.searchsorted(key, key[to - 1], "right"))
        yield slice(at, to)
        at = to


def deletion_variants(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, line number of each) of all lines with one character deleted, and of the lines themselves."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in lines]
    size = np.array([len(c) for c in codes])
    code = K.mix(np.concatenate(codes).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    up, down = K.powers(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(code * up[: len(code)], out=total[1:])
        last = np.cumsum(size)
        first = last - size
        row = np.repeat(np.arange(len(lines)), size)
        at = np.arange(len(code))
        cut = ((total[at] - total[first[row]]) + (total[last[row]] - total[at + 1]) * down[1]) * down[first[row]]
        whole = (total[last] - total[first]) * down[first]
        length = np.concatenate((size[row] - 1, size)).astype(np.uint64)
        h = K.mix(np.concatenate((cut, whole)) + length * np.uint64(0xD6E8FEB86659FD93))
    return h, np.concatenate((row, np.arange(len(lines))))


def _variants(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lines = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_pylist()
            at = np.cumsum([0, *map(len, lines)])
            for i, j in K.slices(at, 1_000_000):
                h, row = deletion_variants(lines[i:j])
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = _runs(h, row)
                yield _flush(h[new], parts, own[i:j][row[new]])

    return run


def _equal_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of lines with an equal variant."""
    blocks = [K.unpack(b, "u4", "u8") for batch in batches for b in batch.column(1).to_pylist()]
    if not blocks:
        return
    key, own = (np.concatenate([b[k] for b in blocks]) for k in range(2))
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    new = _runs(key, own)
    key, own = key[new], own[new]
    many = np.searchsorted(key, key, "right") - np.arange(len(key)) - 1
    edge, at = np.concatenate(([0], np.cumsum(many))), 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + 1_000_000, "right")) - 1)
        c = many[at:to]
        a = np.repeat(np.arange(at, to), c)
        b = a + 1 + np.arange(len(a)) - np.repeat(edge[at:to] - edge[at], c)
        at = to
        x, y = own[a], own[b]
        order = np.lexsort((y, x))
        new = _runs(x[order], y[order])
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x[order][new].view(np.int64)), pa.array(y[order][new].view(np.int64))], names=["x", "y"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with each line dropped that has an earlier equal line, or one within one edit, anywhere in the table.

    Lines are the pieces between newlines, compared without the blanks around them; earlier means a smaller
    (id, line number). A blank line is always kept. A line goes if an earlier one equals it; two lines of at least
    ``min_chars`` characters also count as equal within one insertion, deletion or substitution. It goes whether or not
    the earlier one stays itself. Adds ``n_lines`` and ``n_dropped``, which replace columns of docs with these names;
    other columns stay.

    A null text stays null with 0 lines; rows with a null id stay as they are. Rows repeated under one id tie, so they
    keep the same lines. Texts of any length are taken whole; an empty table stays empty.
    """
    spark = docs.sparkSession
    parts = max(partitions(spark), -(-input_bytes(docs) * 4 // TASK_BYTES))
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__id is not null and __text is not null")

    found = save(src.select("__text").mapInArrow(K.thrifty(_filter_keys(min_chars)), "chunk int, block binary"), "lines-keys")
    count = summed_sketch(found, SKETCH_BITS, _CHUNKS)
    many = np.maximum(1, -(-count // KEY_BLOCK))
    key_parts = max(partitions(spark), -(-int((count * many).sum()) * _KEY_BYTES // TASK_BYTES))
    keys = found.where("chunk is null").select("block").mapInArrow(K.thrifty(_route(key_parts, spark.sparkContext.broadcast(many))), "part int, block binary")
    live = save(keys.repartitionById(key_parts, "part").mapInArrow(K.thrifty(_survivors), "h long").distinct(), "lines-live")

    # a line is known by 128 bits: h finds its near matches, h and g together stand for it
    each = src.select("__id", F.posexplode(_lines(F.col("__text"))).alias("no", "raw"))
    each = each.select("__id", "no", F.btrim("raw", F.lit(_TRIM)).alias("line")).where("line <> ''")
    each = each.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})
    place = F.struct(F.col("__id"), F.col("no"))
    near = _near(each.where(F.length("line") >= min_chars).join(small_enough(live), "h", "left_semi").groupBy("h", "g").agg(F.min(place).alias("first"), F.min("line").alias("line")), parts)

    seen = each.select("__id", "no", "h", "g")
    first = seen.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("times")).join(near, ["h", "g"], "left")
    limit = save(first.where("times > 1 or near is not null").select("h", "g", F.least("first", F.coalesce("near", "first")).alias("limit")), "lines-limit")
    gone = seen.join(small_enough(limit), ["h", "g"]).where(place > F.col("limit")).groupBy("__id").agg(F.collect_set("no").alias("__gone"))
    gone = save(gone, "lines-gone")

    # texts meet their line numbers by a shuffle at every size: as many rows as documents have gone lines
    out = docs.join(gone.hint("shuffle_merge"), column(docs, id_col) == gone["__id"], "left")
    text = column(docs, text_col)
    lines = _lines(text)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone"), lambda i: F.element_at(lines, i + 1)), "\n")
    return out.select(
        *[F.when(F.col("__gone").isNull(), text).otherwise(kept).alias(n) if n == text_col else column(docs, n) for n in docs.columns if n.lower() not in ("n_lines", "n_dropped")],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).alias("n_dropped"),
    )


def _near(lines: DataFrame, parts: int) -> DataFrame:
    """(h, g, near): the earliest place of another line within one edit. lines: h, g, first, line."""
    lines = save(lines, "lines-candidates")
    variants = lines.select("h", "line").mapInArrow(K.thrifty(_variants(parts)), "part int, block binary")
    pairs = variants.repartitionById(parts, "part").mapInArrow(K.thrifty(_equal_variants), "x long, y long").distinct()
    side = lambda n: lines.select(F.col("h").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("g", "first", "line")])
    pairs = pairs.join(side("x"), "x").join(side("y"), "y").where(F.levenshtein("line_x", "line_y", 1) >= 0)
    ends = [F.struct(F.col(a).alias("h"), F.col(f"g_{a}").alias("g"), F.col(f"first_{b}").alias("near")) for a, b in ("xy", "yx")]
    both = pairs.select(F.explode(F.array(*ends)).alias("p")).select("p.*")
    return save(both.groupBy("h", "g").agg(F.min("near").alias("near")), "lines-near")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`line_dedup` as a filter: docs with their first lines only, without the rows that lost all their words.

    Rows that had no words before stay, so do null texts and rows with null ids; repeated rows go or stay together.
    ``n_chars`` follows the text where docs has it; the columns stay as they are, whatever their names. Very long texts
    are taken whole; an empty table stays empty.
    """
    names = docs.columns
    at = {n: f"d{k}" for k, n in enumerate(names)}  # names of their own, so that none can clash with what is added
    out = line_dedup(docs.select(*[column(docs, n).alias(at[n]) for n in names]), at[id_col], at[text_col])
    text = F.col(at[text_col])
    lost = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == "")
    return out.where(~lost).select(*[(F.length(text).cast("long") if n == "n_chars" else F.col(at[n])).alias(n) for n in names])
