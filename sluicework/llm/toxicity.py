"""Toxicity by noisy-channel deobfuscation.

A writer's noisy channel turns letters into look-alikes (leetspeak), spells words out with gaps and repeats letters. A
token that may have come through it becomes a lattice of the characters it can stand for; Viterbi decoding under a
character trigram model picks the restored word. Any other token has one path only, itself, so it needs no decoding; nor
does a token none of whose paths has a word with a weight.
The restored words are scored against weights of words and word beginnings, and a text's sum is compared with what its
length makes likely (a log likelihood ratio of Poisson rates).

All counts that the character model and the weights are made of are taken over all labelled texts, by tasks; the driver
gets the features that have a weight, character trigrams and a hash for each word of three texts or more. Scoring is one
scan without a shuffle, with array operations over all words of a slice at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import column, save, small_enough, table, through_arrow

BEGINNINGS = (4, 5, 6, 7)
MIN_TOXIC_TEXTS = 3
MIN_WEIGHT = 2.0
MIN_ASSOCIATION = 16.0
REMEMBERED = 200_000
#: Longer tokens are decoded each time they occur.
REMEMBERED_CHARS = 64
#: Bytes of texts of which a task counts the features at once.
COUNTED = 4 << 20

_LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiouy", "#": "aeiouy"}
_COST = {c: math.log(0.2 / len(v)) for c, v in _LOOKS.items()}
_REPEAT, _GAP, _BREAK = math.log(0.25), math.log(0.25), math.log(0.25)
_UNKNOWN = math.log(1e-3)
_GAPS = " .-_*"
_CONSONANTS = "bcdfghjklmnpqrstvwxz"
_MASKED, _BESIDE = math.log(0.05 / len(_CONSONANTS)), math.log(0.25)
#: Letters of lower-cased text: a-z and what is above U+00BF, but for the punctuation and symbol blocks and U+10000 up.
_L = "a-z\u00c0-\u1fff\u2c00-\u2fff\u3040-\ud7ff\ue000-\uffff"
_WORD = re.compile(f"[{_L}]+")
_X = "0-9@$!|+*#"
# something to decode: a token with a look-alike beside a letter, or with a letter thrice
_SUSPECT = re.compile(f"(?<![{_L}{_X}])(?:[{_L}]++[{_X}]|[{_X}]++[{_L}]|[{_L}]*?([{_L}])\\1\\1)[{_L}{_X}]*+")
# three or more single characters with the same gap between them
_GAPPED = re.compile(f"(?<![{_L}0-9])[{_L}0-9@$!]([ .\\-_*])[{_L}0-9@$!](?:\\1[{_L}0-9@$!])+(?![{_L}0-9])")
# letters, and single gaps between runs of them
_DOUBLED = re.compile(f"(?<![{_L}])[{_L}]*?([{_L}])\\1[{_L}]*+")
_RUN = re.compile(r"(.)\1+", re.S)
_PIECES = re.compile(f"[{_L}]+(?:[ .\\-_*][{_L}]+)+")
# what words may begin or end at within a restored token
_APART = re.compile(r"[\s.\-_*]")

_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0xC0), *range(0xC3, 0xF0)]] = True
_LOOK_BYTE = np.zeros(256, bool)
_LOOK_BYTE[[*b"0123456789@$!|+*#"]] = True
_GAP_BYTE = np.zeros(256, bool)
_GAP_BYTE[[*b" .-_*"]] = True
_DIGIT_BYTE, _SINGLE_BYTE = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT_BYTE[[*b"0123456789"]] = True
_SINGLE_BYTE[[*b"0123456789@$!"]] = True


def letters(body: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to letters."""
    out = _LETTER_BYTE[body]
    odd = np.flatnonzero((body == 0xC2) | (body == 0xE2) | (body == 0xE3) | (body >= 0xF0))
    if len(odd):
        lead, second = body[odd], body[np.minimum(odd + 1, len(body) - 1)]
        off = (lead == 0xC2) | ((lead == 0xE2) & (second <= 0xAF)) | ((lead == 0xE3) & (second == 0x80)) | (lead >= 0xF0)
        odd, lead = odd[off], lead[off]
        for k, least in enumerate((0xC2, 0xC2, 0xE0, 0xF0)):
            out[np.minimum(odd[lead >= least] + k, len(body) - 1)] = False
    return out


def trigrams(word: str) -> Iterator[str]:
    s = "^^" + word + "\0"
    return (s[i - 2 : i + 1] for i in range(2, len(s)))


class _HashedWords:
    """Counts of many words, by their hashes, twelve bytes a word, and a sieve that few unknown words pass."""

    def __init__(self, hashes: np.ndarray, count: np.ndarray, sizes: list[int]):
        order = np.argsort(hashes)
        self.hashes, self.count, self.sizes = hashes[order], count[order], sizes
        self.mask = (1 << max(16, (8 * len(hashes)).bit_length())) - 1
        sieve = np.zeros(self.mask + 1, np.uint8)
        sieve[(hashes & np.uint64(self.mask)).astype(np.int64)] = 1
        self.sieve = sieve.tobytes()

    def get(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if not self.sieve[h & self.mask]:
            return 0
        at = int(np.searchsorted(self.hashes, np.uint64(h)))
        return int(self.count[at]) if at < len(self.hashes) and self.hashes[at] == h else 0


class CharacterModel:
    """Interpolated character trigrams of words, with ^ before and $ after."""

    def __init__(self, words: dict[str, float], three: Counter | None = None, rare: _HashedWords | None = None, mass: float | None = None):
        """words: how often each occurs; or three: the trigrams of all words, with rare: those that aren't in words, and mass: of all."""
        if three is None:
            three = Counter()
            for w, n in words.items():
                for x in trigrams(w):
                    three[x] += n
        context3, self.two, context2, self.one = Counter(), Counter(), Counter(), Counter()
        for x, n in three.items():
            context3[x[:2]] += n
            self.two[x[1:]] += n
            context2[x[1]] += n
            self.one[x[2]] += n
        total = sum(self.one.values()) or 1.0
        self.three = {k: v / context3[k[:2]] for k, v in three.items()}
        self.two = {k: v / context2[k[0]] for k, v in self.two.items()}
        self.one = {k: v / total for k, v in self.one.items()}
        self.known: dict[str, float] = {}
        mass = mass or sum(words.values()) or 1.0
        self.word = {w: math.log(n / mass) for w, n in words.items()}
        self.rare, self.mass = rare, math.log(mass)
        self.sizes = sorted({len(w) for w in words} | set(rare.sizes if rare else ()))

    def log_word(self, word: str) -> float | None:
        p = self.word.get(word)
        if p is None and self.rare is not None and (n := self.rare.get(word)):
            p = math.log(n) - self.mass
        return p

    def __call__(self, before: str, c: str) -> float:
        value = self.known.get(before + c)
        if value is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            value = self.known[before + c] = self._log(before, c)
        return value

    def split(self, run: str) -> list[str]:
        """The likeliest words of letters whose blanks are lost: known ones, and unknown stretches between them."""
        closed, opened = [(0.0, 0)], [(-math.inf, 0)]  # score, start of the last word
        for i, c in enumerate(run, 1):
            start = max((opened[-1][0], opened[-1][1]), (closed[-1][0] + _UNKNOWN, i - 1), key=lambda x: x[0])
            opened.append((start[0] + math.log(self.one.get(c, 0.0) + 1e-6), start[1]))
            best = opened[-1]
            for n in self.sizes:
                if n > i:
                    break
                p = self.log_word(run[i - n : i])
                if p is not None and closed[i - n][0] + p > best[0]:
                    best = (closed[i - n][0] + p, i - n)
            closed.append(best)
        words, i = [], len(run)
        while i:
            words.append(run[closed[i][1] : i])
            i = closed[i][1]
        return words[::-1]

    def _log(self, before: str, c: str) -> float:
        return math.log(0.7 * self.three.get(before + c, 0.0) + 0.2 * self.two.get(before[-1] + c, 0.0) + 0.1 * self.one.get(c, 0.0) + 1e-6)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """What each character of a token may stand for, with its channel cost; '' is a character that was put in, ' ' a word's end."""
    last = ""
    inner = [i for i, c in enumerate(token) if c.isalpha()]
    first, final = (inner[0], inner[-1]) if inner else (0, len(token) - 1)
    for i, c in enumerate(token):
        options = [(c, 0.0)] if c.isalpha() else []
        if c in _LOOKS:
            options += [(x, _COST[c]) for x in _LOOKS[c]]
        if c in "*#" and token[i - 1 : i] not in ("*", "#") and token[i + 1 : i + 2] not in ("*", "#"):
            options += [(x, _MASKED) for x in _CONSONANTS]
        if c in _GAPS:
            options += [("", _GAP), (" ", _BREAK)]
        elif c == last and (c.isalpha() or c in _LOOKS):
            options.append(("", _REPEAT))
        elif options and not first <= i <= final:  # a mark or number beside the word
            options.append(("", _BESIDE))
        yield options or [(c, 0.0)]
        last = c


def viterbi(token: str, model: CharacterModel) -> str:
    """The most likely word, or words with blanks between them, that the channel turns into this token."""
    states = {"^^": (0.0, None, "")}  # score, cell before, character
    known = model.known
    for options in lattice(token):
        after: dict[str, tuple] = {}
        for before, cell in states.items():
            score, last = cell[0], before[1]
            for c, cost in options:
                if c == "":
                    s, key = score + cost, before
                else:
                    end = "\0" if c == " " else c
                    value = known.get(before + end)
                    s, key = score + cost + (model(before, end) if value is None else value), "^^" if c == " " else last + c
                best = after.get(key)
                if best is None or s > best[0]:
                    after[key] = (s, cell, c)
        states = after
    cell = max(((cell[0] + model(b, "\0"), cell) for b, cell in states.items()), key=lambda x: x[0])[1]
    out = []
    while cell is not None:
        out.append(cell[2])
        cell = cell[1]
    return "".join(reversed(out))


def suspects(text: str) -> Iterator[tuple[int, int]]:
    """Spans of a lower-cased text that the channel may have made, in order and apart."""
    spans = sorted(m.span() for r in (_GAPPED, _SUSPECT) for m in r.finditer(text))
    end = 0
    for a, b in spans:
        if a >= end:
            yield a, b
            end = b


def _association(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio statistic of a feature in a of n toxic and b of m other texts."""
    both = (a + b) / (n + m)
    term = lambda k, size: sum(x * math.log(x / (size * q)) for x, q in ((k, both), (size - k, 1 - both)) if x and q)
    return 2 * (term(a, n) + term(b, m))


def features(word: str) -> list[str]:
    return ["=" + word, *("<" + word[:n] for n in BEGINNINGS if len(word) > n)]


def _counted(column: pa.Array, flags: list[int]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Different features with their (tokens, texts) in other and in toxic texts, [n0, n1, d0, d1], by slices of the texts; '' counts all words and texts."""
    toxic = np.array(flags, np.int64)
    for i, j in K.slices(K.texts(column, lower=False)[1], COUNTED):
        lower = [(x or "").lower() for x in column.slice(i, j - i).to_pylist()]
        yield from _slice_counts(*K.texts(pa.array(lower, pa.large_string()), lower=False), toxic[i:j])


def _slice_counts(body: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    letter = letters(body)
    start, end = _runs(at, letter)
    row = np.searchsorted(at, start, "right") - 1
    yield pa.array([""]), [*np.bincount(toxic[row], minlength=2)[:, None], *np.bincount(toxic, minlength=2)[:, None]]
    if not len(start):
        return
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(body[letter])).dictionary_encode()
    kinds, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    tokens = [np.bincount(code[toxic[row] == t], minlength=len(kinds)) for t in (0, 1)]
    row, code, spread = _by_text(row, code, len(kinds), toxic)
    yield _marked("=", kinds), [*tokens, *spread]
    size = pc.utf8_length(kinds).to_numpy()
    for n in BEGINNINGS:
        longer = np.flatnonzero(size > n)
        begins = pc.utf8_slice_codeunits(kinds.take(pa.array(longer)), 0, n).dictionary_encode()
        found, own = begins.dictionary, np.full(len(kinds), -1)
        own[longer] = begins.indices.to_numpy()
        many = [np.bincount(own[longer], weights=x[longer], minlength=len(found)).astype(np.int64) for x in tokens]
        has = np.flatnonzero(own[code] >= 0)
        spread = _by_text(row[has], own[code[has]], len(found), toxic)[2]
        yield _marked("<", found), [*many, *spread]


def _marked(kind: str, found: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(kind, found.type), found, pa.scalar("", found.type))


def _by_text(row: np.ndarray, code: np.ndarray, kinds: int, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different pairs (row, code), and in how many other and toxic texts each code is."""
    pair = np.sort(row * kinds + code)
    row, code = np.divmod(pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]], max(1, kinds))
    return row, code, [np.bincount(code[toxic[row] == t], minlength=kinds) for t in (0, 1)]


def _weight(n0: int, n1: int, d0: int, d1: int, words: list[float], sizes: list[int]) -> float:
    """The weight of a feature, 0 if it has none."""
    if d1 < MIN_TOXIC_TEXTS:
        return 0.0
    w = math.log((n1 + 0.5) / words[1] / ((n0 + 0.5) / words[0]))
    return w if w >= MIN_WEIGHT and _association(d1, sizes[1], d0, sizes[0]) >= MIN_ASSOCIATION else 0.0


class _Counts:
    """What a model is made of, from texts at hand."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.of: dict[str, list[int]] = {"": [0, 0, 0, 0]}
        for found, counts in _counted(pa.array([x for x, _ in rows], pa.large_string()), [t for _, t in rows]):
            for f, *c in zip(found.to_pylist(), *(x.tolist() for x in counts)):
                self.of[f] = [x + y for x, y in zip(self.of.get(f, (0, 0, 0, 0)), c)]
        n0, n1, d0, d1 = self.of.pop("")
        self.words, self.sizes = [1.0 + n0, 1.0 + n1], [d0, d1]

    def weights(self) -> dict[str, float]:
        return {f: w for f, c in self.of.items() if (w := _weight(*c, self.words, self.sizes))}

    def hits(self, weight: dict[str, float]) -> list[int]:
        """Tokens, in other and in toxic texts, of the words with a weight."""
        hit = [c for f, c in self.of.items() if f[0] == "=" and any(x in weight for x in features(f[1:]))]
        return [sum(c[t] for c in hit) for t in (0, 1)]

    def characters(self, lexicon: set[str]) -> CharacterModel:
        own = {f[1:]: float(c[2] + c[3]) for f, c in self.of.items() if f[0] == "=" and c[2] + c[3] >= MIN_TOXIC_TEXTS}
        mass = sum(own.values()) or 1.0
        for w in lexicon:  # what is hidden is likely one of these words
            own[w] = own.get(w, 0.0) + 0.5 * mass / len(lexicon)
        return CharacterModel(own)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found, counts in _counted(batch.column(0), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([found.cast(pa.string()), *map(pa.array, counts)], names=["f", "n0", "n1", "d0", "d1"])


def _hit_batches(weight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = weight.value, [0, 0]
        for batch in batches:
            for f, n0, n1 in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if any(x in known for x in features(f[1:])):
                    total[0] += n0
                    total[1] += n1
        yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1]])], names=["n0", "n1"])

    return run


def _trigram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    three: Counter[str] = Counter()
    for batch in batches:
        for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for x in trigrams(f[1:]):
                three[x] += n
    yield pa.RecordBatch.from_arrays([pa.array(three.keys(), pa.string()), pa.array(three.values(), pa.int64())], names=["x", "n"])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [f[1:] for f in batch.column(0).to_pylist()]
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        count = np.minimum(batch.column(1).to_numpy(), 2**32 - 1).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([K.pack(h, count)], pa.binary()), pa.array([sorted({len(w) for w in words})], pa.list_(pa.int32()))], names=["block", "sizes"])


class _TaskCounts:
    """The same as `_Counts`, counted by tasks over rows (text, toxic) of any number."""

    def __init__(self, rows: DataFrame):
        found = rows.mapInArrow(K.thrifty(_feature_batches), "f string, n0 long, n1 long, d0 long, d1 long")
        self.of = save(found.groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1"))), "toxicity-features")
        n0, n1, d0, d1 = next(iter(self.of.where("f = ''").select("n0", "n1", "d0", "d1").collect()), (0, 0, 0, 0))
        self.words, self.sizes = [1.0 + n0, 1.0 + n1], [d0, d1]
        self.spark = rows.sparkSession

    def weights(self) -> dict[str, float]:
        # the same tests as _weight, a little wider, so that few rows come to the driver
        ratio = F.log((F.col("n1") + 0.5) / F.lit(self.words[1])) - F.log((F.col("n0") + 0.5) / F.lit(self.words[0]))
        sizes = [F.lit(float(max(1, x))) for x in self.sizes]
        both = (F.col("d0") + F.col("d1")) / (sizes[0] + sizes[1])
        term = lambda k, size, q: F.when((k > 0) & (q > 0), k * F.log(k / (size * q))).otherwise(0.0)
        statistic = 2 * sum(term(F.col(d), x, both) + term(x - F.col(d), x, 1 - both) for d, x in zip(("d0", "d1"), sizes))
        kept = self.of.where("f <> ''").where((F.col("d1") >= MIN_TOXIC_TEXTS) & (ratio >= MIN_WEIGHT - 1e-6) & (statistic >= MIN_ASSOCIATION - 1e-3))
        return {r.f: w for r in kept.collect() if (w := _weight(r.n0, r.n1, r.d0, r.d1, self.words, self.sizes))}

    def hits(self, weight: dict[str, float]) -> list[int]:
        known = self.spark.sparkContext.broadcast(frozenset(weight))
        found = self.of.where("f like '=%'").select("f", "n0", "n1").mapInArrow(_hit_batches(known), "n0 long, n1 long").agg(F.sum("n0"), F.sum("n1")).first()
        return [x or 0 for x in found]

    def characters(self, lexicon: set[str]) -> CharacterModel:
        own = self.of.where(f"f like '=%' and d0 + d1 >= {MIN_TOXIC_TEXTS}").select("f", (F.col("d0") + F.col("d1")).alias("n"))
        three: Counter[str] = Counter()
        for r in own.mapInArrow(_trigram_batches, "x string, n long").groupBy("x").agg(F.sum("n").alias("n")).toLocalIterator():
            three[r.x] = float(r.n)
        found = own.mapInArrow(K.thrifty(_hash_batches), "block binary, sizes array<int>").toLocalIterator()
        blocks = [(K.unpack(bytes(r.block), "u8", "u4"), r.sizes) for r in found]
        hashes, count = (np.concatenate([np.zeros(0, kind), *(b[k] for b, _ in blocks)]) for k, kind in ((0, np.uint64), (1, np.uint32)))
        rare = _HashedWords(hashes, count, sorted({n for _, x in blocks for n in x}))
        mass = float(count.sum(dtype=np.int64)) or 1.0
        words = {}
        for w in lexicon:
            words[w] = rare.get(w) + 0.5 * mass / len(lexicon)
            for x in trigrams(w):
                three[x] += 0.5 * mass / len(lexicon)
        return CharacterModel(words, three, rare, mass + sum(words.values()) - sum(map(rare.get, lexicon)))


class Model:
    """Weights of words and beginnings, rates of their hits, and the character model."""

    features = staticmethod(features)

    def __init__(self, rows: list[tuple[str, int]] | _TaskCounts):
        """rows: (text, toxic) of labelled texts, or what was counted of them."""
        counts = _Counts(rows) if isinstance(rows, list) else rows
        self.weight = counts.weights()
        rates = [hit / words for hit, words in zip(counts.hits(self.weight), counts.words)]
        self.cost = rates[1] - rates[0]
        self.prior = math.log((counts.sizes[1] + 1) / (counts.sizes[0] + 1))
        lexicon = {f[1:] for f in self.weight if f[0] == "="}
        self.characters = counts.characters(lexicon)
        # what repeats can't change: a word's letters with each run as one
        self.single = {_RUN.sub(r"\1", f[1:]) for f in self.weight if f[0] == "="}
        self.begins = {_RUN.sub(r"\1", f[1:]) for f in self.weight if f[0] == "<"}
        self.begin_sizes = sorted(set(map(len, self.begins)))
        self.longest = max(map(len, lexicon), default=0)
        self.opens = {w[:n] for w in lexicon for n in range(1, len(w) + 1)}
        self.lexicon, self.starts = lexicon, {f[1:] for f in self.weight if f[0] == "<"}
        self.ahead = self.opens | {w[:n] for w in self.starts for n in range(1, len(w) + 1)}
        self.tables = [self._table({f[1:]: w for f, w in self.weight.items() if f[0] == kind}) for kind in "=<"]
        self.memory: dict[str, str] = {}
        self.gains: dict[str, tuple[float, int]] = {}  # of suspects
        self.doubled: dict[int, bool] = {}  # by a word's hash, whether it gains by dropping doubled letters

    @staticmethod
    def _table(weight: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes, their weights, and a sieve of the hashes' upper bits."""
        raw = [f.encode() for f in weight]
        size = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(size)
        h = K.spans(np.frombuffer(b"".join(raw), np.uint8), ends - size, ends)
        order = np.argsort(h)
        sieve = np.zeros(1 << 16, bool)
        sieve[(h >> np.uint64(48)).astype(np.int64)] = True
        return h[order], np.array(list(weight.values()))[order], sieve

    def of(self, word: str) -> float:
        most = self.weight.get("=" + word, 0.0)
        for n in BEGINNINGS:
            if len(word) <= n:
                break
            most = max(most, self.weight.get("<" + word[:n], 0.0))
        return most

    def restore(self, token: str) -> str:
        """The words that a token may hide, with blanks between them."""
        words = self.memory.get(token)
        if words is None:
            words = viterbi(token, self.characters)
            if any(c in _GAPS for c in token):  # a word model knows better where words end
                words = " ".join(self.characters.split(words.replace(" ", "")))
            if len(token) <= REMEMBERED_CHARS:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[token] = words
        return words

    def _gain(self, token: str, words: str) -> tuple[float, int]:
        new = [w for w in map(self.of, words.split()) if w > 0]
        old = [w for w in map(self.of, _WORD.findall(token)) if w > 0]
        more = sum(new) - sum(old)
        return (more, max(1, len(new) - len(old))) if more > 0 else (0.0, 0)

    def _may_hide(self, token: str) -> bool:
        """Whether some path through a token's lattice has a word with a weight; any other token needs no decoding."""
        apart = _APART.search(token) is not None  # its words may begin and end anywhere
        now = {""}
        for options in lattice(token):
            after = {""} if apart else set()
            for c, _ in options:
                after.update(now if c == "" else (x for w in now if (x := w + c) in self.ahead))
            if not self.starts.isdisjoint(after) or (apart and not self.lexicon.isdisjoint(after)):
                return True
            if not after:
                return False
            now = after
        return not self.lexicon.isdisjoint(now)

    def _suspect_gain(self, token: str) -> tuple[float, int]:
        """(weight, hits) that a suspect adds, restored."""
        gain = self.gains.get(token)
        if gain is None:
            gain = self._gain(token, self.restore(token)) if self._may_hide(token) else (0.0, 0)
            if len(token) <= REMEMBERED_CHARS:
                if len(self.gains) >= REMEMBERED:
                    self.gains.clear()
                self.gains[token] = gain
        return gain

    def _may_repeat(self, word: str) -> bool:
        """Whether a word with a weight may come out of this one by dropping repeated letters; any other needs no decoding."""
        one = _RUN.sub(r"\1", word)
        return one in self.single or any(one[:n] in self.begins for n in self.begin_sizes)

    def plain(self, text: str) -> Iterator[tuple[str, str]]:
        """(what stands there, the word it may hide) for words with doubled letters and for words cut by single gaps."""
        taken = []
        for m in _PIECES.finditer(text):
            words = [(w.start() + m.start(), w.end() + m.start()) for w in _WORD.finditer(m[0])]
            i = 0
            while i < len(words):
                own, found = "", 0
                for j in range(i, len(words)):
                    own += text[slice(*words[j])]
                    if own not in self.opens:  # no word goes on like this
                        break
                    if j > i and "=" + own in self.weight:
                        found, hidden = j, own
                if found:
                    taken.append((words[i][0], words[found][1]))
                    yield text[words[i][0] : words[found][1]], hidden
                i = max(i, found) + 1
        taken.append((len(text), len(text)))
        k = 0
        for m in _DOUBLED.finditer(text):
            while taken[k][1] <= m.start():
                k += 1
                if k == len(taken):
                    return
            if m.end() <= taken[k][0] and self._may_repeat(m[0]):
                yield m[0], self.restore(m[0])

    def hidden(self, text: str, plain: bool = True) -> tuple[float, int]:
        """(weight, hits) that the restored words of a lower-cased text add to those in plain sight.

        plain: whether to look outside the suspects too; it changes nothing where no word out there gains.
        """
        gain, hits, end = 0.0, 0, 0
        for a, b in [*suspects(text), (len(text), len(text))]:
            more = [self._suspect_gain(text[a:b])] if a < b else []
            more += [self._gain(x, y) for x, y in self.plain(text[end:a])] if plain else []
            gain += sum(g for g, _ in more)
            hits += sum(h for _, h in more)
            end = b
        return gain, hits

    def score_one(self, text: str | None) -> tuple[float, int, int]:
        """(score, hits, hits that were hidden) of one text, word by word: what `score` does for many."""
        text = (text or "").lower()
        words = _WORD.findall(text)
        total, hidden = self.hidden(text)
        hits = sum(self.of(w) > 0 for w in words)
        return total + sum(self.of(w) for w in words) - self.cost * len(words) + self.prior, hits + hidden, hidden

    def _values(self, kind: int, h: np.ndarray) -> np.ndarray:
        keys, value, sieve = self.tables[kind]
        out = np.zeros(len(h))
        if len(keys):
            maybe = np.flatnonzero(sieve[(h >> np.uint64(48)).astype(np.int64)])
            own = h[maybe]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            out[maybe] = np.where(keys[at] == own, value[at], 0.0)
        return out

    def _doubled_words(self, body: np.ndarray, words: _LetterWords, letter: np.ndarray) -> np.ndarray:
        """Words that, freed of doubled letters, have more weight; each different one is decoded once."""
        own = np.unique(_repeated(body, letter, words.start, words.end, 2))
        kinds, first, back = np.unique(words.hash[own], return_index=True, return_inverse=True)
        more = np.zeros(len(first), bool)
        if len(self.doubled) >= REMEMBERED:
            self.doubled.clear()
        for k, (h, i) in enumerate(zip(kinds.tolist(), own[first].tolist())):
            gains = self.doubled.get(h)
            if gains is None:
                word = body[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace")
                gains = self.doubled[h] = bool(self._may_repeat(word) and _DOUBLED.fullmatch(word)) and self._gain(word, self.restore(word))[0] > 0
            more[k] = gains
        return own[more[back]]

    def _joined_words(self, body: np.ndarray, words: _LetterWords, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) of neighbouring words, a single gap between each two, that together are a word with a weight; of one first the longest come first."""
        keys = self.tables[0][0]
        n = len(words.start)
        if n < 2 or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = (words.start[1:] - words.end[:-1] == 1) & (words.row[1:] == words.row[:-1]) & _GAP_BYTE[body[np.minimum(words.end[:-1], len(body) - 1)]]
        near = np.append(near, False)
        size = place[words.end - 1] - place[words.start] + 1
        raw, length = words.raw, words.end - words.start
        up = K.powers(int(length.sum()) + self.longest * 4 + 2)[0]
        head = last = np.flatnonzero(near)
        value, wide, chars = raw[head], length[head], size[head]
        found = [(head[:0], head[:0])]
        while len(head):
            last = last + 1
            with np.errstate(over="ignore"):
                value = value + raw[last] * up[wide]
                wide, chars = wide + length[last], chars + size[last]
                fits = chars <= self.longest
                head, last, value, wide, chars = (x[fits] for x in (head, last, value, wide, chars))
                h = K.mix(value + wide.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            hit = self._values(0, h) > 0
            found.append((head[hit], last[hit]))
            on = near[last]
            head, last, value, wide, chars = (x[on] for x in (head, last, value, wide, chars))
        head, last = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-last, head))
        return head[order], last[order]

    def score(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, hits, hidden hits) of the lower-cased texts body[at[i]:at[i + 1]]."""
        rows = len(at) - 1
        total, letter = K.prefix(body), letters(body)
        words = _LetterWords(body, at, letter, total)
        value = self._values(0, words.hash)
        begins = (body & 0xC0) != 0x80
        lead = np.append(np.flatnonzero(begins), len(body))
        place = np.cumsum(begins) - 1
        first = place[words.start]
        for n in BEGINNINGS:
            stop = lead[np.minimum(first + n, len(lead) - 1)]
            longer = np.flatnonzero(stop < words.end)
            value[longer] = np.maximum(value[longer], self._values(1, K.spans(body, words.start[longer], stop[longer], total)))
        got = np.bincount(words.row, weights=value, minlength=rows)
        hits = np.bincount(words.row, weights=value > 0, minlength=rows).astype(np.int64)
        hidden = np.zeros(rows, np.int64)
        doubled, (head, last) = self._doubled_words(body, words, letter), self._joined_words(body, words, place)
        for r, (gain, more) in self._restored(body, words, doubled, head, last, *_suspect_spans(body, at, letter, lead, place)):
            got[r] += gain
            hidden[r] += more
        return got - self.cost * words.count + self.prior, hits + hidden, hidden

    def _restored(self, body: np.ndarray, words: _LetterWords, doubled: np.ndarray, head: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, tuple[float, int]]]:
        """(row, (weight, hits)) of what `hidden` finds: suspects, then words outside of them that are cut, or have doubled letters."""
        raw = body.tobytes()
        text = lambda a, b: raw[a:b].decode("utf-8", "replace")
        for r, a, b in zip(row.tolist(), start.tolist(), end.tolist()):
            gain = self._suspect_gain(text(a, b))
            if gain[1]:
                yield r, gain

        def outside(first: np.ndarray, final: np.ndarray) -> np.ndarray:
            return np.append(start, len(raw))[np.searchsorted(end, words.start[first], "right")] >= words.end[final]

        taken, until = np.zeros(len(words.start), bool), -1
        own = outside(head, last)
        for i, j in zip(head[own].tolist(), last[own].tolist()):
            x = text(words.start[i], words.end[j])
            y = "".join(_WORD.findall(x))
            if i > until and "=" + y in self.weight:
                taken[i : j + 1], until = True, j
                yield int(words.row[i]), self._gain(x, y)
        for i in doubled[outside(doubled, doubled) & ~taken[doubled]].tolist():
            x = text(words.start[i], words.end[i])
            yield int(words.row[i]), self._gain(x, self.restore(x))


def _runs(at: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of marked bytes within texts."""
    inside = np.zeros(len(here) + 2, bool)
    inside[1:-1] = here
    cut = np.zeros(len(here) + 1, bool)
    cut[at] = True
    before, here = inside[:-1], inside[1:]
    return np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))


def _repeated(body: np.ndarray, letter: np.ndarray, start: np.ndarray, end: np.ndarray, times: int) -> np.ndarray:
    """Which runs have a letter so many times in sequence: their numbers, repeated and in any order."""
    found = [np.zeros(0, np.int64)]
    for w, (low, high) in enumerate(((0, 0x80), (0xC0, 0xE0), (0xE0, 0xF0)), 1):  # by the bytes of a letter
        n = len(body) - w * times + 1
        if n <= 0:
            continue
        own = body[:n]
        at = np.flatnonzero((own == body[w : n + w]) & letter[:n] & (own >= low) & (own < high))
        for k in range(1, w * (times - 1)):
            at = at[body[at + k] == body[at + k + w]]
        run = np.searchsorted(start, at, "right") - 1
        found.append(run[at + w * times <= end[run]])
    return np.concatenate(found)


class _LetterWords:
    """Runs of letters: starts, ends, row, hash and number by row."""

    def __init__(self, body: np.ndarray, at: np.ndarray, letter: np.ndarray, total: np.ndarray):
        self.start, self.end = _runs(at, letter)
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=len(at) - 1)
        self.hash = K.spans(body, self.start, self.end, total)
        with np.errstate(over="ignore"):
            self.raw = (total[self.end] - total[self.start]) * K.powers(len(body) + 1)[1][self.start]


def _suspect_spans(body: np.ndarray, at: np.ndarray, letter: np.ndarray, lead: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the suspects of all texts."""
    # what _SUSPECT matches: runs of letters and look-alikes with both, or with a letter thrice
    start, end = _runs(at, letter | _LOOK_BYTE[body])
    count = np.concatenate(([0], np.cumsum(letter)))
    count = count[end] - count[start]
    found = (count > 0) & (count < end - start)
    found[_repeated(body, letter, start, end, 3)] = True
    start, end = start[found], end[found]
    row = np.searchsorted(at, start, "right") - 1
    gapped = _gapped_rows(body, at, letter, lead, place)
    if len(gapped):  # there both kinds of suspects meet
        own = ~np.isin(row, gapped)
        spans = [(start[own], end[own], row[own])]
        for r in gapped.tolist():
            both = np.array(list(suspects(body[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace"))), np.int64).reshape(-1, 2)
            spans.append((*lead[place[at[r]] + both].T, np.full(len(both), r)))
        start, end, row = (np.concatenate(x) for x in zip(*spans))
        order = np.argsort(start)
        start, end, row = start[order], end[order], row[order]
    return start, end, row


def _gapped_rows(body: np.ndarray, at: np.ndarray, letter: np.ndarray, lead: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Texts that may hold a match of _GAPPED: a superset, by its first two gaps and the characters beside them."""
    gap = np.flatnonzero(_GAP_BYTE[body])
    c, p = body[gap], place[gap]
    two = np.flatnonzero((c[1:] == c[:-1]) & (p[1:] - p[:-1] == 2))
    a, b = gap[:-1][two], gap[1:][two]
    single = np.append(letter | _SINGLE_BYTE[body], False)  # also for what is before or behind all texts
    more = single[a - 1] & single[a + 1] & single[b + 1]
    a = a[more]
    first = lead[place[a] - 1]
    within = np.append(letter | _DIGIT_BYTE[body], False)
    starts = np.zeros(len(body) + 1, bool)
    starts[at] = True
    return np.unique(np.searchsorted(at, a[~within[first - 1] | starts[first]], "right") - 1)


_OUT = "score double, hits bigint, hidden bigint, toxic boolean"


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            body, at = K.texts(batch.column(0))
            for i, j in K.slices(at):
                score, hits, hidden = model.score(body[at[i] : at[j]], at[i : j + 1] - at[i])
                score = np.round(score, 6)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own.columns[1:], pa.array(score), pa.array(hits), pa.array(hidden), pa.array(score > 0)], names=[*own.schema.names[1:], "score", "hits", "hidden", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all labelled texts.

    Labels with a null id or a null flag are left out; where an id has several labels or texts the greatest one counts.
    Without any labelled text no word has a weight.
    """
    chosen = labels.where(f"{id_col} is not null and toxic is not null").groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.max("toxic").cast("int") > 0).cast("int").alias("toxic"))
    chosen = save(chosen, "toxicity-labels")
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    several = save(src.where("__id is not null").groupBy("__id").count().where("count > 1").select("__id"), "toxicity-several")
    rows = src.join(small_enough(chosen), "__id")
    one = rows.join(small_enough(several), "__id", "left_anti").select("text", "toxic")
    if not several.isEmpty():  # only these texts are shuffled
        one = one.union(rows.join(small_enough(several), "__id", "left_semi").groupBy("__id", "toxic").agg(F.max("text").alias("text")).select("text", "toxic"))
    return Model(_TaskCounts(one))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with ``score``, ``hits``, ``hidden`` and ``toxic``.

    ``score`` is the log likelihood ratio with the prior of the labels; a text is toxic above 0. ``hits`` counts words
    with a weight, ``hidden`` those of them that had to be restored.

    A null, empty or wordless text has the prior as its score and isn't toxic. Texts of any length are read whole, and
    tokens of any length decoded. Columns of docs with one of the four
    names are replaced; the others stay, as do repeated rows. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return through_arrow(docs, text_col, keep, _scorer(shared), _OUT)


def clean_only(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without its toxic rows; the columns stay as they are, whatever their names.

    The model is fitted on the tables documents and labels in sf_dir. Rows without words (null, empty or blank texts) and
    rows with a null id stay; repeated rows stay or go together; texts of any length are read whole. An empty table stays
    empty, and without labelled texts all rows stay.
    """
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    # the columns go through Python under names of their own, so that none can clash with the scores
    plain = docs.select(F.col("text").alias("__t"), *[column(docs, n).alias(f"d{k}") for k, n in enumerate(docs.columns)])
    scored = score_toxicity(plain, model, "__t", keep=[f"d{k}" for k in range(len(docs.columns))])
    return scored.where("not toxic").select(*[F.col(f"d{k}").alias(n) for k, n in enumerate(docs.columns)])
