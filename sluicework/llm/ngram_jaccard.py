"""N-gram Jaccard join by vertical partitioning.

Every text becomes the set of its word n-grams. A global order over n-grams (rare first, by a fixed-width count
sketch over the whole corpus, ties by hash) is cut into fragments of equal mass. Overlaps are counted inside each
fragment on its own and summed per pair. Two lossless filters keep the fragments small:

* texts with equal n-gram sets are one class, joined through its smallest id only;
* sets of a crowd, near copies that share most of their least hashes with many others, are compared with each other at
  once, all with all in cells, and never through the n-grams that they share;
* sets with Jaccard >= t share an n-gram among the first ``len - ceil(t * len) + 1`` of the global order, and the number
  of such shared prefix grams with what is left behind the prefixes bounds the overlap; only pairs whose bound
  reaches the overlap they need enter the fragments. A text's mark is the least hash of its prefix grams: texts of one
  mark meet once, in the list of the mark, and are left out of the lists of all the grams that they share.

Shuffles carry packed blocks (about 7 bytes a posting), never one row per n-gram; the only broadcast is the rarity of
the sketch's buckets, one byte each, whose number is fixed. The result has one row for each document: its near-duplicate class and the
number of its links, which are counted where the overlaps are summed, so pairs are never expanded into rows.

What grows hot is split. Postings of a frequent n-gram go to cells of two blocks of its texts each, and so do the
segments of a large group: every two blocks meet in one cell, and a cell has a bounded number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_BYTES, column, partitions, save, small_enough

N = 3
#: Similarity of near copies: in the given tables hardly any pair lies between 0.3 and 0.5, and those above are edited copies.
THRESHOLD = 0.5
FRAGMENTS = 4
SKETCH_BITS = 24
#: Steps of rarity for each doubling of a bucket's count.
STEPS = 8
#: Texts of a block: two blocks of a group's texts, or of a frequent n-gram's, meet in one task.
GROUP_BLOCK = 1024
LIST_BLOCK = 16_384
#: Least hashes of a set by which crowds are found, sets that share one of a crowd's, the part of the sets with either of
#: two hashes that must have both for these to be of one crowd (one in so many), and n-grams of a block of a crowd.
LEAST = 16
CROWD = 64
MATES = 4
CROWD_GRAMS = 1 << 20
#: Edges of 16 bytes that one task may connect.
SMALL_EDGES = 1_000_000
#: Bytes of postings that a task is meant to hold.
TASK_BYTES = 48 << 20
_SEGMENT = "grp long, cell int, fragment int, id long, size int, owner long, copies long, side int, grams binary, crowd long"
_BLOCK = "part int, block binary"
_LINKS = "id long, root long, links long"
_CHUNKS = 256
_FLUSH = 2_000_000
_LOW = np.uint64(64 - SKETCH_BITS)
_LEVEL = np.uint64(56)
_MARK = 4
#: A mark has a gram's level and the rest of 32 bits of it, spread by a product whose inverse gathers it again.
_SPARE = np.uint32(24)
_SPREAD, _GATHER = np.uint32(2654435761), np.uint32(pow(2654435761, -1, 1 << 32))


def prefix_length(size: int, t: float) -> int:
    return size - int(np.ceil(t * size - 1e-9)) + 1


def _set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _keys(n: int):
    """Pass 1: the key of each text's set (null without words), its least hashes, and the task's part of the count sketch."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("size", pa.int32()), ("low", pa.list_(pa.int64())), ("chunk", pa.int32()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, any_row = np.zeros(1 << SKETCH_BITS, np.uint32), False
        for batch in batches:
            ids, pool = batch.column(0), []
            key, size, low = [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for row, own in K.gram_sets(batch.column(1), n):
                key[row], size[row], low[row] = _set_key(own), len(own), own[:LEAST].view(np.int64)
                pool.append((own >> _LOW).astype(np.int64))
                if len(pool) >= 512:
                    np.add.at(sketch, np.concatenate(pool), np.uint32(1))
                    pool = []
            if pool:
                np.add.at(sketch, np.concatenate(pool), np.uint32(1))
            if nulls := batch.num_rows:
                any_row = True
                yield pa.RecordBatch.from_arrays([ids, pa.array(key, pa.binary()), pa.array(size, pa.int32()), pa.array(low, pa.list_(pa.int64())), pa.nulls(nulls, pa.int32()), pa.nulls(nulls, pa.binary())], schema=schema)
        if any_row:
            for k, part in enumerate(sketch.reshape(_CHUNKS, -1)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:4]), pa.array([k], pa.int32()), pa.array([K.pack(part)], pa.binary())], schema=schema)

    return run


def _level(count: np.ndarray) -> np.ndarray:
    """The rarity of each count, in steps of equal ratio."""
    return np.floor(STEPS * np.log2(np.maximum(count, 1)) + 1e-9).clip(0, 255).astype(np.uint8)


def _add_levels(pdf):
    count = sum(K.unpack(b, "u4")[0].astype(np.int64) for b in pdf["block"])
    level = _level(count)
    mass = np.bincount(level, weights=count, minlength=256).astype(np.int64)
    return pdf.iloc[:1][["chunk"]].assign(block=[K.pack(level)], mass=[K.pack(mass)])


def _order(first: DataFrame, fragments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The level of every sketch bucket (rare first), the fragments' bounds in the global order, and the blocks by level."""
    level, mass = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.uint8), np.zeros(256, np.int64)
    for r in first.where("chunk is not null").select("chunk", "block").groupBy("chunk").applyInPandas(_add_levels, "chunk int, block binary, mass binary").toLocalIterator():
        level[r.chunk] = K.unpack(bytes(r.block), "u1")[0]
        mass += K.unpack(bytes(r.mass), "i8")[0]
    upto = np.cumsum(mass)
    cuts = []
    for f in range(1, fragments):  # hashes are even inside a level
        k = int(np.searchsorted(upto, goal := upto[-1] * f / fragments))
        cuts.append((k << int(_LEVEL)) + int((goal - (upto[k] - mass[k])) / max(1, mass[k]) * ((1 << int(_LEVEL)) - 1)))
    most = np.exp2((np.arange(256) + 1) / STEPS)  # texts that have a gram of the level
    return level.ravel(), np.array(cuts, np.uint64), np.maximum(1, np.ceil(most / LIST_BLOCK)).astype(np.int64)


def _relabel(level: np.ndarray):
    """Gram hashes with their level in place of the first bits, so that the natural order is the global order."""
    low = np.uint64((1 << int(_LEVEL)) - 1)
    return lambda g: (level[(g >> _LOW).astype(np.int64)].astype(np.uint64) << _LEVEL) | (g & low)


def _wanted(batch: pa.RecordBatch) -> list[bytes | None]:
    """Per row: None to take it, a key that its set must have, or b'' to leave it out."""
    return batch.column(2).to_pylist()


def _by_part(part: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Packed blocks of the columns, one for each part."""
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    out = [(p, K.pack(*(c[o] for c in columns))) for p in range(parts) if len(o := order[edge[p] : edge[p + 1]])]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["part", "block"])


def _postings(n: int, t: float, parts: int, rank, many):
    """Pass 2: blocks of (hash, text, position, kind) of the prefix grams and marks, with a table of the texts in each.

    many: blocks of the texts that have a gram, by its level. kind: the side in the cell, and whether it is a mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        relabel, blocks = _relabel(rank.value), many.value
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            g = np.concatenate([h[0] for h in held])
            each = np.array([len(h[0]) for h in held])
            ids, lens, crowd = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
            code = (((g >> _LEVEL).astype("u4") << _SPARE) | (g & np.uint64((1 << int(_SPARE)) - 1)).astype("u4")) * _SPREAD
            mark = np.minimum.reduceat(code, np.cumsum(each) - each)
            doc = np.repeat(np.arange(len(held)), each)
            pos = (np.arange(len(g)) - np.repeat(np.cumsum(each) - each, each)) * 256 // lens[doc]
            with np.errstate(over="ignore"):
                h = np.concatenate((K.mix(g), K.mix(mark.astype(np.uint64) + np.uint64(1 << 40))))
            split = blocks[np.concatenate(((g >> _LEVEL).astype(np.int64), ((mark * _GATHER) >> _SPARE).astype(np.int64)))]
            kind = np.repeat(np.array([0, _MARK], np.uint8), (len(g), len(held)))
            doc, pos = np.concatenate((doc, np.arange(len(held)))), np.concatenate((pos, np.zeros(len(held), np.int64))).astype(np.uint8)
            hot = np.flatnonzero(split > 1)
            if len(hot):
                own = (K.mix(ids[doc[hot]].astype(np.uint64)) % split[hot].astype(np.uint64)).astype(np.int64)
                row, cell, side = K.cells(own, split[hot])
                cold = np.flatnonzero(split == 1)
                with np.errstate(over="ignore"):
                    h = np.concatenate((h[cold], K.mix(h[hot[row]] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
                pick = np.concatenate((cold, hot[row]))
                doc, pos, kind = doc[pick], pos[pick], np.concatenate((kind[cold], kind[hot[row]] + side.astype(np.uint8)))
            part = ((h >> np.uint64(34)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            out = []
            for k in range(parts):
                o = order[edge[k] : edge[k + 1]]
                if len(o):
                    docs, at = np.unique(doc[o], return_inverse=True)
                    out.append((k, K.pack(ids[docs].astype("i8"), lens[docs].astype("u4"), mark[docs], crowd[docs]), K.pack((h[o] & np.uint64(0xFFFFFFFF)).astype("u4"), at.astype("u4"), pos[o], kind[o])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "docs", "block"])

        for batch in batches:
            ids, crowd, drop = batch.column(0).to_pylist(), batch.column(4).to_pylist(), _left_out(batch, n)
            for r, own in K.gram_sets(batch.column(1), n, relabel):
                if r in drop:
                    continue
                p = prefix_length(len(own), t)
                held.append((own[:p], ids[r], len(own), crowd[r]))
                size += p
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _pairs_of(h: np.ndarray, ids: np.ndarray, lens: np.ndarray, mark: np.ndarray, pos: np.ndarray, kind: np.ndarray, crowd: np.ndarray, t: float) -> Iterator[list[np.ndarray]]:
    """Folded pairs of postings that share a hash, are on different sides of their cell if it has sides, and pass the length filter.

    All postings are of grams, or all of marks. Pairs of equal marks are found by the mark alone, those of one crowd (0:
    none) not here. The texts of a crowd stand together, before those in none, and are only put beside what follows them.
    """
    order = np.lexsort((lens, crowd.view(np.uint64) - np.uint64(1), h))
    h = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    keep = same[1:] | same[:-1]
    order, h = order[keep], h[keep]
    ids, lens, side, mark, crowd = ids[order], lens[order].astype(np.int64), kind[order] & 3, mark[order], crowd[order]
    by_mark = bool(len(kind)) and bool(kind[0] & _MARK)
    rest = lens - pos[order].astype(np.int64) * lens // 256 - 1
    behind = np.ceil(t * lens - 1e-9).astype(np.int64) - 1  # grams behind the prefix
    most = np.minimum(np.floor(lens / t + 1e-9), 2**32 - 1).astype(np.int64)
    start, many = np.arange(1, len(h) + 1), np.zeros(len(h), np.int64)
    free = np.flatnonzero(crowd == 0)
    key = (h[free].astype(np.uint64) << np.uint64(32)) | lens[free].astype(np.uint64)
    until = np.searchsorted(key, (h[free].astype(np.uint64) << np.uint64(32)) | most[free].astype(np.uint64), "right")
    many[free] = until - np.arange(len(free)) - 1
    if len(free) < len(h):
        other = np.concatenate((h[1:] != h[:-1], [True]))
        over = np.flatnonzero(other)
        stop = np.flatnonzero(other | np.concatenate((crowd[1:] != crowd[:-1], [True])))
        own = np.flatnonzero(crowd)
        start[own] = stop[np.searchsorted(stop, own)] + 1
        many[own] = over[np.searchsorted(over, own)] + 1 - start[own]
    edge, at = np.concatenate(([0], np.cumsum(many))), 0
    while at < len(h):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + 300_000, "right")) - 1)
        c = many[at:to]
        a = np.repeat(np.arange(at, to), c)
        b = start[a] + np.arange(len(a)) - np.repeat(edge[at:to] - edge[at], c)
        at = to
        ok = (ids[a] != ids[b]) & (lens[a] <= most[b]) & (lens[b] <= most[a]) & ((side[a] == 0) | (side[a] != side[b])) & ((mark[a] == mark[b]) == by_mark)
        a, b = a[ok], b[ok]
        need = np.ceil(t / (1 + t) * (lens[a] + lens[b]) - 1e-6).astype(np.int64)
        x, y = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        if by_mark:  # the others of their shared grams aren't counted: they pass
            yield _fold(x, y, need, np.zeros_like(need), need, need)
        else:
            left = np.minimum(rest[a], rest[b])
            yield _fold(x, y, np.ones(len(a), np.int64), np.minimum(left, np.maximum(behind[a], behind[b])), left, need)


def _fold(x: np.ndarray, y: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> list[np.ndarray]:
    """One row by pair: shared prefix grams, what can still be common behind the last and the first of them, overlap needed."""
    if not len(x):
        return [x, y, count, low, high, need]
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    return [x[at], y[at], np.add.reduceat(count[order], at), np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), need[order][at]]


_PAIR = ("i8", "i8", "u4", "u4", "u4", "u4")


def _candidates(t: float, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(K.unpack(d, "i8", "u4", "u4", "i8"), K.unpack(b, "u4", "u4", "u1", "u1")) for batch in batches for d, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if not found:
            return
        ids, lens, mark, crowd = (np.concatenate([d[k] for d, _ in found]) for k in range(4))
        h, pos, kind = (np.concatenate([b[k] for _, b in found]) for k in (0, 2, 3))
        first = np.cumsum([0, *(len(d[0]) for d, _ in found)])
        doc = np.concatenate([b[1].astype(np.int64) + f for (_, b), f in zip(found, first)])
        del found
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pairs = _fold(*(np.concatenate(c) for c in zip(*held)))
            return _by_part(_pair_part(pairs[0], pairs[1], parts), parts, *(c.astype(k) for c, k in zip(pairs, _PAIR)))

        for marks in (True, False):
            own = np.flatnonzero(((kind & _MARK) > 0) == marks)
            of = doc[own]
            for pairs in _pairs_of(h[own], ids[of], lens[of], mark[of], pos[own], kind[own], crowd[of], t):
                held.append(pairs)
                size += len(pairs[0])
                if size > 800_000:
                    held = [_fold(*(np.concatenate(c) for c in zip(*held)))]
                    size = len(held[0][0])
                    if size > 400_000:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    return run


def _pair_part(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """By a, so that its pairs pack well, and by 16 buckets of b, so that no a with many partners is in one task."""
    return (K.mix(K.mix(a.astype(np.uint64)) + (K.mix(b.astype(np.uint64)) & np.uint64(15))) % np.uint64(parts)).astype(np.int64)


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that can reach the overlap they need.

    The common grams up to the earlier end of the two prefixes are all in both, so they are counted. The others are
    behind the last shared one, in either set, and behind the prefix of the set that ends earlier.
    """
    held, size = [], 0
    for batch in batches:
        for b in batch.column(1).to_pylist():
            held.append([c.astype(np.int64) for c in K.unpack(b, *_PAIR)])
            size += len(held[-1][0])
            if size > 800_000:
                held = [_fold(*(np.concatenate(c) for c in zip(*held)))]
                size = len(held[0][0])
    if not held:
        return
    x, y, count, low, high, need = _fold(*(np.concatenate(c) for c in zip(*held)))
    ok = (count + low >= need) & (high + 1 >= need)
    x, y = x[ok], y[ok]
    for i in range(0, len(x), 500_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 500_000]), pa.array(y[i : i + 500_000])], names=["a", "b"])


def _left_out(batch: pa.RecordBatch, n: int) -> set[int]:
    """Rows of a batch that the marks leave out: those marked b'', and texts of an id that aren't the one that counts.

    The key belongs to the unrelabelled set, so it is only made for the rare ids with several texts.
    """
    wanted = _wanted(batch)
    drop = {r for r, w in enumerate(wanted) if w == b""}
    keyed = {r for r, w in enumerate(wanted) if w}
    if keyed:
        drop |= {r for r, own in K.gram_sets(batch.column(1), n) if r in keyed and _set_key(own) != wanted[r]}
    return drop


def _segments(n: int, rank, cuts):
    """Pass 3: the part of every candidate's set that lies in each fragment, once per cell it is compared in."""
    names = ["grp", "cell", "fragment", "id", "size", "owner", "copies", "side", "grams", "crowd"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        relabel = _relabel(rank.value)
        for batch in batches:
            ids, copies, owner, cells, crowd = (batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6))
            drop = _left_out(batch, n)
            rows: list[tuple] = []
            held = 0
            for r, own in K.gram_sets(batch.column(1), n, relabel):
                if r in drop:
                    continue
                for f, seg in enumerate(np.split(own, np.searchsorted(own, cuts))):
                    if len(seg):
                        block = seg.tobytes()
                        for c in cells[r]:
                            rows.append((c["grp"], c["cell"], f, ids[r], len(own), owner[r], copies[r], c["side"], block, crowd[r]))
                            held += len(block) + 68
                            if held > 8 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                                rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return run


def _overlaps(segs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, overlap), by place a < b, of the segments that meet in the fragment."""
    m = len(segs)
    if m < 2:
        return
    each = [np.frombuffer(s, np.uint64) for s in segs]
    if m == 2:
        o = len(each[0]) + len(each[1]) - len(np.unique(np.concatenate(each)))
        if o:
            yield np.array([0]), np.array([1]), np.array([o])
        return
    row = np.repeat(np.arange(m), [len(s) for s in each])
    _, col, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    live = times > 1
    slot = np.cumsum(live) - 1
    on = live[col]
    row, col, width = row[on], slot[col[on]], int(live.sum())
    if not width:
        return
    wide, tall = max(1, 8_000_000 // m), max(1, 8_000_000 // m)
    for top in range(0, m, tall):
        end = min(m, top + tall)
        total = np.zeros((end - top, m), np.float32)
        for left in range(0, width, wide):
            here = (col >= left) & (col < left + wide)
            bits = np.zeros((m, min(wide, width - left)), np.float32)
            bits[row[here], col[here] - left] = 1
            total += bits[top:end] @ bits.T
        a, b = np.nonzero(total)
        later = b > a + top
        a, b = a[later], b[later]
        yield a + top, b, total[a, b].astype(np.int64)


_OVERLAP = ("i8", "i8", "u4", "u4", "u4", "i8", "i8")


def _count(t: float, parts: int):
    """Inside one fragment: partial overlaps of the pairs of each cell. Rows come sorted by (grp, cell, fragment).

    Two texts may meet in several groups. The pair belongs to the group of the one with the smaller id, and only there
    it is counted; no candidate is missed, as it was sent there. Pairs of one crowd are counted in its own cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            part, *columns = (np.concatenate(c) for c in zip(*held))
            return _by_part(part, parts, *(c.astype(k) for c, k in zip(columns, _OVERLAP)))

        def count() -> None:
            nonlocal size
            ids, lens, owner, copies, side, crowd = (np.concatenate(c).astype(np.int64) for c in zip(*now_rows))
            order = np.argsort(ids, kind="stable")
            if (ids[order][1:] == ids[order][:-1]).any():  # a repeated row
                order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))]
            ids, lens, owner, copies, side, crowd = (c[order] for c in (ids, lens, owner, copies, side, crowd))
            part = int(K.mix(K.mix(np.array([now[0]]).view(np.uint64)) + np.uint64(now[1]))[0] % np.uint64(parts))
            for a, b, o in _overlaps([segs[k] for k in order]):
                fits = np.minimum(lens[a], lens[b]) >= t * np.maximum(lens[a], lens[b]) - 1e-9
                fits &= (crowd[a] != crowd[b]) | (crowd[a] == 0)
                fits &= (owner[a] == now[0]) & ((side[a] == 0) | (side[a] != side[b]))
                a, b, o = a[fits], b[fits], o[fits]
                held.append((np.full(len(a), part), ids[a], ids[b], o, lens[a], lens[b], copies[a], copies[b]))
                size += len(a)

        now, now_rows, segs = None, [], []
        for batch in batches:
            g, c, f, i, s, w, k, d, q = (batch.column(x).to_numpy(zero_copy_only=False) for x in (*range(8), 9))
            x = batch.column(8).to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (f[1:] != f[:-1])))) if len(g) else []
            for lo, hi in zip(edge, [*edge[1:], len(g)]):
                if (g[lo], c[lo], f[lo]) != now:
                    if len(segs) > 1:
                        count()
                    now, now_rows, segs = (g[lo], c[lo], f[lo]), [], []
                now_rows.append((i[lo:hi], s[lo:hi], w[lo:hi], k[lo:hi], d[lo:hi], q[lo:hi]))
                segs += x[lo:hi]
                if size > 400_000:
                    yield flush()
                    held, size = [], 0
        if len(segs) > 1:
            count()
        if size:
            yield flush()

    return run


def local_roots(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each is connected to) of the edges x - y."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for k in (a, b):
            np.minimum.at(new, root[k], low)
            np.minimum.at(new, k, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _sum(t: float):
    """Sums the fragments' overlaps per pair: (id, root, links) of every text with a link.

    links: documents that are similar enough, copies of the other texts included; root: the smallest text that this one
    is connected to by the pairs of the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [K.unpack(b, *_OVERLAP) for batch in batches for b in batch.column(1).to_pylist()]
        if not blocks:
            return
        a, b, o, la, lb, ca, cb = (np.concatenate([x[k] for x in blocks]).astype(np.int64) for k in range(7))
        del blocks
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        total, first = np.add.reduceat(o[order], at), order[at]
        like = total / (la[first] + lb[first] - total) >= t
        a, b, first = a[at][like], b[at][like], first[like]
        if not len(a):
            return
        ids, root = local_roots(a, b)
        links = np.bincount(np.searchsorted(ids, a), weights=cb[first], minlength=len(ids)) + np.bincount(np.searchsorted(ids, b), weights=ca[first], minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(links.astype(np.int64))], names=["id", "root", "links"])

    return run


def place_roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the places 0 to m - 1 that each is connected to by the edges a - b."""
    root = np.arange(m)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _crowd_links(t: float):
    """(id, root, links), as `_sum` gives them, of the whole sets that meet in each cell of a crowd. Rows come sorted by (grp, cell)."""

    def count(rows: list[tuple], segs: list[bytes]) -> pa.RecordBatch | None:
        ids, lens, copies, side = (np.concatenate(c).astype(np.int64) for c in zip(*rows))
        ids, first = np.unique(ids, return_index=True)  # a repeated row counts once
        lens, copies, side = lens[first], copies[first], side[first]
        m = len(ids)
        links, root = np.zeros(m), np.arange(m)
        for a, b, o in _overlaps([segs[k] for k in first]):
            like = (o / (lens[a] + lens[b] - o) >= t) & ((side[a] == 0) | (side[a] != side[b]))
            a, b = a[like], b[like]
            links += np.bincount(a, weights=copies[b], minlength=m) + np.bincount(b, weights=copies[a], minlength=m)
            root = place_roots(m, np.concatenate((a, np.arange(m))), np.concatenate((b, root)))
        on = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[root[on]]), pa.array(links[on].astype(np.int64))], names=["id", "root", "links"]) if len(on) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, segs = None, [], []
        for batch in batches:
            g, c, i, s, k, d = (batch.column(x).to_numpy(zero_copy_only=False) for x in (0, 1, 3, 4, 6, 7))
            x = batch.column(8).to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])))) if len(g) else []
            for lo, hi in zip(edge, [*edge[1:], len(g)]):
                if (g[lo], c[lo]) != now:
                    if len(segs) > 1 and (out := count(rows, segs)) is not None:
                        yield out
                    now, rows, segs = (g[lo], c[lo]), [], []
                rows.append((i[lo:hi], s[lo:hi], k[lo:hi], d[lo:hi]))
                segs += x[lo:hi]
        if len(segs) > 1 and (out := count(rows, segs)) is not None:
            yield out

    return run


def _crowds(sets: DataFrame) -> DataFrame | None:
    """(id, size, crowd) of the sets in crowds, None if there are none. What is a crowd changes the work, not the result.

    Two hashes that are least in many sets belong to one crowd if they often occur together; a set is in a crowd if more
    than half of its least hashes are the crowd's. So texts that only share a line or a frequent n-gram are in none.
    Copies that were cut to different lengths have different least hashes, which a chain of such pairs connects.
    """
    low = sets.where("key is not null and (rep is null or rep = id)").select("id", "size", F.size("low").alias("all"), F.explode("low").alias("mark"))
    hot = save(low.groupBy("mark").agg(F.count("*").alias("many")).where(F.col("many") >= CROWD), "jaccard-hot")
    if hot.isEmpty():
        return None
    held = low.join(small_enough(hot), "mark").groupBy("id", "size", "all").agg(F.array_sort(F.collect_list(F.struct("mark", "many"))).alias("own"))
    held = save(held.where(F.size("own") * 2 > F.col("all")), "jaccard-held")
    one = held.select("own", F.posexplode("own").alias("at", "x"))
    two = one.select("x", F.explode(F.expr("slice(own, at + 2, size(own))")).alias("y")).groupBy("x", "y").agg(F.count("*").alias("both"))
    mates = save(two.where(f"both * {MATES} >= greatest(x.many, y.many)").select(F.col("x.mark").alias("a"), F.col("y.mark").alias("b")), "jaccard-mates")
    roots = save(components(mates), "jaccard-crowd-roots")
    roots = roots.select(F.col("id").alias("mark"), "root").union(roots.select(F.col("root").alias("mark"), "root")).distinct()
    mine = held.select("id", "size", "all", F.explode("own.mark").alias("mark")).join(small_enough(save(roots, "jaccard-crowd-marks")), "mark")
    mine = mine.groupBy("id", "size", "all", "root").agg(F.count("*").alias("shared")).where("shared * 2 > all and root <> 0")
    return save(mine.select("id", "size", F.col("root").alias("crowd")), "jaccard-crowds")


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, fragments: int = FRAGMENTS
) -> DataFrame:
    """(doc_id, class_id, n_links): the join of docs with itself on the Jaccard similarity of word n-gram sets.

    ``n_links`` is the number of other documents whose similarity with this one is at least ``threshold``, copies
    included; ``class_id`` is the smallest id that links lead to from here, the document's own without any. The result
    counts the whole join: no link is capped or dropped, however large a group.

    Null, empty and wordless texts have no n-gram and link to nothing, not to each other either; a text of fewer than n
    words has one gram of all of them. Rows with a null id are left out. Repeated rows count once; where an id has
    several texts the one with the smallest set key counts. Very long texts are taken whole. Other columns of docs are
    not read, whatever their names. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    first = save(src.mapInArrow(K.thrifty(_keys(n)), "id long, key binary, size int, low array<bigint>, chunk int, block binary"), "jaccard-keys")
    keys = first.where("chunk is null").groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("last"), F.min_by("size", "key").alias("size"), F.min_by("low", "key").alias("low"))
    keys = save(keys.select("id", "key", "size", "low", (F.col("key") != F.col("last")).alias("several")), "jaccard-sets")
    copies = save(keys.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "jaccard-copies")
    sets = keys.join(small_enough(copies), "key", "left")
    # what the later passes need to know of a row: b'' to leave it out, or the key that its set must have; and its copies
    wanted = F.when(F.col("rep") != F.col("id"), F.lit(b"")).when(F.col("several"), F.col("key"))
    marks = save(sets.where("several or copies > 1").select("id", wanted.alias("wanted"), F.coalesce("copies", F.lit(1)).alias("copies")), "jaccard-marks")

    crowds = _crowds(sets)
    rank, cuts, many = _order(first, fragments)
    grams = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(partitions(spark), -int(-grams * (1 - threshold) * 18 // TASK_BYTES))
    rank = spark.sparkContext.broadcast(rank)
    many = spark.sparkContext.broadcast(many)
    marked = src.join(small_enough(marks), "id", "left").select("id", "text", "wanted", F.coalesce("copies", F.lit(1)).alias("copies"))
    marked = marked.where("wanted is null or wanted <> x''")
    if crowds is None:
        marked = marked.withColumn("crowd", F.lit(0).cast("long"))
    else:
        marked = marked.join(small_enough(crowds.select("id", "crowd")), "id", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0)))
    postings = marked.mapInArrow(K.thrifty(_postings(n, threshold, parts, rank, many)), "part int, docs binary, block binary")
    found = postings.repartitionById(parts, "part").mapInArrow(K.thrifty(_candidates(threshold, parts)), _BLOCK)
    pairs = save(found.repartitionById(parts, "part").mapInArrow(K.thrifty(_merge_pairs), "a long, b long"), "jaccard-candidates")

    segments = marked.join(small_enough(_groups(pairs), most_bytes=BROADCAST_BYTES), "id").select("id", "text", "wanted", "copies", "owner", "cells", "crowd").mapInArrow(K.thrifty(_segments(n, rank, cuts)), _SEGMENT)
    partial = segments.repartition(parts, "grp", "cell", "fragment").sortWithinPartitions("grp", "cell", "fragment").mapInArrow(K.thrifty(_count(threshold, parts)), _BLOCK)
    linked = save(partial.repartitionById(parts, "part").mapInArrow(K.thrifty(_sum(threshold)), _LINKS), "jaccard-links")
    if crowds is not None:
        size = crowds.groupBy("crowd").agg(F.count("*").alias("texts"), F.sum("size").alias("grams"))
        blocks = F.ceil(F.greatest(F.col("texts") / GROUP_BLOCK, F.col("grams") / CROWD_GRAMS)).cast("int")
        cells = _cells(crowds.join(small_enough(save(size, "jaccard-crowd-sizes")), "crowd").select("id", F.col("crowd").alias("grp"), blocks.alias("blocks")))
        sent = marked.join(small_enough(save(cells, "jaccard-crowd-cells"), most_bytes=BROADCAST_BYTES), "id").select("id", "text", "wanted", "copies", F.lit(0).cast("long").alias("owner"), "cells", "crowd")
        whole = sent.mapInArrow(K.thrifty(_segments(n, rank, np.zeros(0, np.uint64))), _SEGMENT).repartition(parts, "grp", "cell").sortWithinPartitions("grp", "cell")
        linked = linked.union(save(whole.mapInArrow(K.thrifty(_crowd_links(threshold)), _LINKS), "jaccard-crowd-links"))

    roots = components(linked.select(F.col("root").alias("a"), F.col("id").alias("b"))).withColumnRenamed("id", "rep")
    links = linked.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")).join(roots, "rep", "left")
    out = sets.select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")).join(small_enough(save(links, "jaccard-linked")), "rep", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def _groups(pairs: DataFrame) -> DataFrame:
    """(id, owner, cells): where the sets of pairs (a, b) meet.

    A group is the smallest candidate partner: the copies of one text meet in one group and are sent there once. A group
    of more than GROUP_BLOCK texts is cut into blocks, every two of which meet in a cell. owner: the group of the pairs
    in which this id is the smaller one.
    """
    least = save(pairs.groupBy("b").agg(F.min("a").alias("least")).withColumnRenamed("b", "id"), "jaccard-least")
    grouped = pairs.join(small_enough(least.withColumnRenamed("id", "a")), "a", "left").withColumn("grp", F.coalesce("least", "a"))
    member = save(grouped.select("grp", F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-members")
    large = member.groupBy("grp").count().where(F.col("count") > GROUP_BLOCK).select("grp", F.ceil(F.col("count") / GROUP_BLOCK).cast("int").alias("blocks"))
    split = member.join(small_enough(save(large, "jaccard-large")), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = _cells(split).join(least, "id", "left")
    return save(cells.select("id", F.coalesce("least", "id").alias("owner"), "cells"), "jaccard-needed")


def _cells(split: DataFrame) -> DataFrame:
    """(id, cells) of the members (id, grp, blocks) of groups: every two blocks of a group meet in a cell."""
    own, other = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.col("other")
    split = split.select("id", "grp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(other == F.col("own"), 0).when(F.col("own") < other, 1).otherwise(2)
    cell = F.struct("grp", (high * (high + 1) / 2 + low).cast("int").alias("cell"), side.alias("side"))
    return split.groupBy("id").agg(F.collect_list(cell).alias("cells"))


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        ids, root = local_roots(*(np.concatenate(c) for c in zip(*held)))
        below = root != ids
        yield pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(root[below])], names=["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id connected to each other id of edges (a, b), by alternating large and small stars.

    Up to SMALL_EDGES counted edges are connected in one task instead, with the same result. Each round's edges are written to the shared folder; the rounds grow with the logarithm of the longest path. The
    least neighbours are aggregated before they meet the edges again, so a hub's edges are never in one task.
    """

    def least(side: DataFrame) -> DataFrame:
        return side.join(side.groupBy("a").agg(F.min("b").alias("m")), "a")

    now, before = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "stars"), None
    if now.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        return now.repartition(1).mapInArrow(K.thrifty(_one_task), "id long, root long")
    while True:
        near = least(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = near.where("b > a").select(F.least("a", "m").alias("a"), "b").where("a <> b").distinct()
        low = least(save(large.select(F.col("b").alias("a"), F.col("a").alias("b")), "large-stars"))
        small = low.select(F.col("m").alias("a"), F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b")).distinct()
        now = save(small, "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("b").alias("id"), F.col("a").alias("root"))
        before = seen


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the members of a near-duplicate class other than its smallest id.

    A class is one of `ngram_jaccard_join`. Rows in no class of several, with null ids or without words stay; of several
    rows with one id all stay or go together. Very long texts are compared whole. The columns of docs stay as they are,
    whatever their names; an empty table stays empty.
    """
    found = ngram_jaccard_join(docs, id_col, text_col, **how)
    gone = save(found.where("class_id <> doc_id").select(F.col("doc_id").alias("__gone")), "jaccard-gone")
    return docs.join(small_enough(gone), column(docs, id_col).cast("long") == F.col("__gone"), "left_anti")
