"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens with array operations over their code points. Tier one finds every pre-token that is
itself in the vocabulary through a minimal perfect hash (displaced buckets over 64-bit hashes), for all pre-tokens of a
slice at once. Tier two merges the others, once per distinct pre-token in a task's memory of recent ones, with a heap of
adjacent pairs over a linked list of bytes. Decoding gathers the tokens' bytes and is compared with the text.

The vocabulary file is read on the driver from a path that is a parameter; the workers get it as a broadcast of fixed
size. The plan is one scan without a shuffle.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels as K
from .common import through_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pre-tokens that a task remembers; beyond it the memory starts anew. It bounds memory, not results.
REMEMBERED = 200_000
#: Bytes of text that are encoded at once; a longer text is whole.
SLICE = 1 << 19
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(i))[0]
        out[i] = _LETTER if first == "L" else _NUMBER if first == "N" else _OTHER
    out[list(_SPACES)] = _SPACE
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}


class PerfectHash:
    """A bijection of n distinct 64-bit keys to 0..n-1, as one displacement for each of about n/4 buckets."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("the keys aren't distinct")
        self.n, self.buckets = n, max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(size) - size
        taken = np.zeros(n, bool)
        ones = []
        tries = np.arange(1, 4001, dtype=np.int64)
        for b in np.argsort(-size, kind="stable"):
            k = size[b]
            if k == 0:
                break
            own = keys[order[first[b] : first[b] + k]]
            if k == 1:
                ones.append(b)
                continue
            d = 0
            while True:
                at = self._slots(own[None, :], (tries[:200] + d)[:, None])
                fit = ~taken[at].any(axis=1)
                if k > 1:
                    s = np.sort(at, axis=1)
                    fit &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(fit)
                if len(hit):
                    self.shift[b] = tries[hit[0]] + d
                    taken[at[hit[0]]] = True
                    break
                d += 200
        # a bucket of one key takes any free slot: its displacement is that slot, negative
        self.shift[ones] = -1 - np.flatnonzero(~taken)[: len(ones)]

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (K.mix(keys ^ (shift.astype(np.uint64) * _SPREAD)) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(keys, shift))


class Codec:
    """Encoder and decoder of a rank vocabulary; it can be pickled, so one broadcast serves all workers."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        ids = np.array([ranks[t] for t in tokens], np.int32)
        lengths = np.array([len(t) for t in tokens], np.int64)
        ends = np.cumsum(lengths)
        body = np.frombuffer(b"".join(tokens), np.uint8)
        keys = K.spans(body, ends - lengths, ends)
        self.hash = PerfectHash(keys)
        slot = self.hash(keys)
        self.slot_key, self.slot_id, self.slot_length = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
        self.slot_key[slot], self.slot_id[slot], self.slot_length[slot] = keys, ids, lengths
        self.vocabulary = body
        top = int(ids.max()) + 1
        self.start, self.length = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.start[ids], self.length[ids] = ends - lengths, lengths
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = r
        self.classes = character_classes()
        self.memory: dict[int, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memory": {}, "classes": None, "zipped": K.pack(self.classes)}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.classes = K.unpack(self.__dict__.pop("zipped"), "u1")[0]

    def merge(self, word: bytes) -> list[int]:
        """Merges the adjacent pair of least rank, leftmost first, until none is in the vocabulary."""
        pairs, n = self.pairs, len(word)
        token = [self.byte_id[b] for b in word]
        right, left, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            r = pairs.get(token[i] << 32 | token[i + 1])
            if r is not None:
                heap.append((r, i, token[i], token[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if token[i] != a or j >= n or token[j] != b:
                continue  # one of the two has been merged since
            token[i], token[j] = r, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                q = pairs.get(r << 32 | token[k])
                if q is not None:
                    heapq.heappush(heap, (q, i, r, token[k]))
            h = left[i]
            if h >= 0:
                q = pairs.get(token[h] << 32 | r)
                if q is not None:
                    heapq.heappush(heap, (q, h, token[h], r))
        return [t for t in token if t >= 0]

    def pieces(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte positions at which the pre-tokens of the texts body[at[i]:at[i + 1]] begin."""
        code = np.frombuffer(body.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        if not n:
            return np.zeros(0, np.int64)
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        width[(code >= 0xDC80) & (code <= 0xDCFF)] = 1  # a byte that isn't UTF-8 is a character of its own
        begin = np.cumsum(width) - width
        cut = np.zeros(n + 1, bool)
        edge = at[:-1][at[:-1] < at[1:]]
        cut[np.searchsorted(begin, edge)] = True
        cut[n] = True
        kind = self.classes[code]
        new = cut.copy()
        new[1:n] |= kind[1:] != kind[:-1]
        new[0] = True
        start = new.copy()
        run = np.flatnonzero(new)  # run k is run[k]:run[k + 1]
        k = np.flatnonzero(kind[run[:-1]] == _SPACE)
        end = run[k + 1]
        end = end[~cut[end]]  # white space before something else: its last character goes with that or stands alone
        start[end - 1] = True
        start[end[code[end - 1] == 0x20]] = False
        # 's 't 'd 'm 'll 've 're, where the apostrophe begins a pre-token
        q = np.flatnonzero((code == 39) & start[:n] & new[1:])
        q = q[(q + 1 < n)]
        q = q[(kind[q + 1] == _LETTER) & ~cut[q + 1]]
        one = np.isin(code[q + 1], [ord(c) for c in "sdmt"])
        second = np.where((q + 2 < n) & ~cut[np.minimum(q + 2, n)], code[np.minimum(q + 2, n - 1)], 0)
        first = code[q + 1]
        two = ((first == 108) & (second == 108)) | (((first == 118) | (first == 114)) & (second == 101))
        hit = one | two
        stop = q[hit] + np.where(one[hit], 2, 3)
        start[q[hit] + 1] = False
        start[stop] = True
        return begin[np.flatnonzero(start[:n])]

    def encode(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by text) of the texts body[at[i]:at[i + 1]]."""
        start = self.pieces(body, at)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        end = np.concatenate((start[1:], [len(body)]))
        h = K.spans(body, start, end)
        slot = self.hash(h)
        known = (self.slot_key[slot] == h) & (self.slot_length[slot] == end - start)
        size = np.ones(len(start), np.int64)
        miss = np.flatnonzero(~known)
        _, sample, which = np.unique(h[miss], return_index=True, return_inverse=True)
        found, memory, raw = [], self.memory, body.tobytes()
        for key, s in zip(h[miss[sample]].tolist(), miss[sample].tolist()):
            ids = memory.get(key)
            if ids is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                ids = memory[key] = self.merge(raw[start[s] : end[s]])
            found.append(ids)
        sizes = np.array([len(x) for x in found], np.int64)
        size[miss] = sizes[which]
        last = np.cumsum(size)
        out = np.empty(last[-1], np.int32)
        out[last[known] - 1] = self.slot_id[slot[known]]
        if len(miss):
            flat = np.array([t for x in found for t in x], np.int32)
            origin = (np.cumsum(sizes) - sizes)[which]
            many = size[miss]
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            out[np.repeat(last[miss] - many, many) + step] = flat[np.repeat(origin, many) + step]
        row = np.searchsorted(at, start, "right") - 1
        return out, np.bincount(row, weights=size, minlength=len(at) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.vocabulary[np.arange(total) + np.repeat(self.start[ids] - (end - size), size)]


@lru_cache(maxsize=2)
def codec(path: str = VOCABULARY) -> Codec:
    return Codec(read_ranks(path))


_SCHEMA = pa.schema([("tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())])


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            body, at = K.texts(batch.column(0), lower=False)
            for i, j in K.slices(at, SLICE):
                lo, hi = at[i], at[j]
                ids, count = c.encode(body[lo:hi], at[i : j + 1] - lo)
                same = _equal(c.decode(ids), np.cumsum(c.length[ids]), body[lo:hi], at[i : j + 1] - lo, count)
                edge = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                own = batch.slice(i, j - i)
                tokens = pa.ListArray.from_arrays(pa.array(edge), pa.array(ids))
                gone = own.column(0).is_null()
                if gone.true_count:
                    tokens = pa.ListArray.from_arrays(pa.array(edge, mask=np.append(gone.to_numpy(zero_copy_only=False), False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*own.columns[1:], tokens, pa.array(count), pa.array(same)], names=[*own.schema.names[1:], *_SCHEMA.names])

    return run


def _equal(back: np.ndarray, ends: np.ndarray, body: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each text's tokens give back its bytes."""
    last = np.cumsum(count)
    cut = np.concatenate(([0], ends))[last] if len(ends) else np.zeros(len(count), np.int64)
    if len(back) == len(body) and (cut == at[1:]).all() and (back == body).all():
        return np.ones(len(count), bool)
    begin = np.concatenate(([0], cut[:-1]))
    return np.array([np.array_equal(back[a:b], body[c:d]) for a, b, c, d in zip(begin, cut, at[:-1], at[1:])])


def encode_documents(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with ``tokens`` array<int>, ``n_tokens`` and ``round_trip``.

    ``tokens`` are the ids of the whole text, of any length; ``round_trip`` says that decoding them gave back the text's
    bytes. A null text has null tokens, 0 of them and a true round trip; an empty one has an empty list. Bytes that
    aren't UTF-8 are characters of their own. The three names replace columns of docs that have them; other columns stay
    as they are, as do repeated rows. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec(path))
    return through_arrow(docs, text_col, keep, _encode(shared), "tokens array<int>, n_tokens bigint, round_trip boolean")


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            lists = batch.column(0).cast(pa.large_list(pa.int64()))
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(c.length[ids])))
            at = ends[np.concatenate(([0], np.cumsum(count)))].astype(np.int64)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(c.decode(ids).tobytes())])
            try:
                text = raw.cast(pa.large_string())
            except pa.ArrowInvalid:  # somewhere the bytes aren't UTF-8
                text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
            text = pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], text], names=[*batch.schema.names[1:], "text"])

    return run


def decode_documents(encoded: DataFrame, tokens_col: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """The columns of encoded with ``text``, decoded from its tokens, which replaces a column of that name.

    Null tokens give a null text, an empty list an empty one; lists of any length are decoded whole, repeated rows stay.
    Bytes that aren't UTF-8 are replaced. An empty table stays empty; the other columns stay as they are.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(codec(path))
    return through_arrow(encoded, tokens_col, None, _decode(shared), "text string")
