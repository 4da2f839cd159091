"""Word-level language identification with a linear-chain conditional random field.

Every word has features: its beginnings and ends (affixes), its inner character n-grams, and whether it is in the
lexicon of a language (frequent words of the sample). A label's score for a word is the sum of its features' weights;
transition weights between labels are learned with them, by maximising the likelihood of code-switched sequences.
Labels come from the marginals of forward-backward, so a foreign phrase inside a text gets its own language.

The field is trained on the driver on whole texts of a bounded sample of documents with a known language, spliced into
code-switched sequences. Labelling is one scan without a shuffle. Weights of a word are looked up once per distinct word
of a slice, and forward-backward runs over all texts of a slice at once: texts are cut into chunks, the product of each
chunk's transfer matrices carries the messages from one chunk to the next, and then all chunks are labelled together.
That is the exact forward-backward of the whole text, of any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import save, small_enough, through_arrow
from .toxicity import letters

#: Documents of the sample, those with the smallest id hashes.
SAMPLE = 600
#: Feature buckets.
BITS = 17
LEXICON = 400
EPOCHS = 6
RATE = 0.15
DECAY = 1e-5
#: Words of a chunk, whose messages are passed on: the result doesn't depend on it.
CHUNK = 32
_AFFIX = (1, 2, 3, 4)
_SEED = 5


class Words:
    """Runs of letters of some lower-cased texts: starts, ends, row, first word of each row."""

    def __init__(self, body: np.ndarray, at: np.ndarray):
        n = len(body)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = letters(body)
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        before, here = inside[:-1], inside[1:]
        self.start = np.flatnonzero(here & (~before | cut))
        self.end = np.flatnonzero(before & (~here | cut))
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=len(at) - 1)
        self.total = K.prefix(body)
        self.hash = K.spans(body, self.start, self.end, self.total)


def features(body: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the hashed features of the words body[start:end].

    Affixes of 1 to 4 and inner n-grams of 3 characters, counted in UTF-8 characters, and the whole word.
    """
    begins = (body & 0xC0) != 0x80
    lead = np.append(np.flatnonzero(begins), len(body))
    place = np.cumsum(begins) - 1
    first = place[start]
    size = np.where(end > start, place[end - 1] + 1 - first, 0)
    number = np.arange(len(start))
    out, who = [], []

    def add(kind: int, a: np.ndarray, b: np.ndarray, word: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            h = K.mix(K.spans(body, a, b, total) + np.uint64(kind) * np.uint64(0x9E3779B97F4A7C15))
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
        who.append(word)

    add(0, start, end, number)
    for n in _AFFIX:
        long = np.flatnonzero(size >= n)
        add(n, start[long], lead[first[long] + n], long)
        add(16 + n, lead[first[long] + size[long] - n], end[long], long)
    inner = np.maximum(size - 2, 0)
    word = np.repeat(number, inner)
    step = np.arange(len(word)) - np.repeat(np.cumsum(inner) - inner, inner)
    p = first[word] + step
    add(32, lead[p], lead[p + 3], word)
    return np.concatenate(out), np.concatenate(who)


def forward_backward(emission: np.ndarray, transition: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, log partition) of chains. emission: (chains, words, labels); transition: (labels, labels), scores.

    Works with scaled probabilities, so that no chain length over- or underflows. Words behind a chain's length have
    no weight.
    """
    chains, words, labels = emission.shape
    top = emission.max(axis=2, keepdims=True)
    e, step = np.exp(emission - top), np.exp(transition)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    scale = np.ones((chains, words))
    now = e[:, 0]
    for i in range(words):
        if i:
            now = (alpha[:, i - 1] @ step) * e[:, i]
        scale[:, i] = now.sum(axis=1)
        alpha[:, i] = now / scale[:, i, None]
    live = np.arange(words)[None, :] < length[:, None]
    for i in range(words - 2, -1, -1):
        back = (beta[:, i + 1] * e[:, i + 1]) @ step.T
        back /= back.sum(axis=1, keepdims=True)
        beta[:, i] = np.where(live[:, i + 1, None], back, 1.0)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    return marginal, np.where(live, np.log(scale) + top[:, :, 0], 0.0).sum(axis=1)


def _step(before: np.ndarray, step: np.ndarray) -> np.ndarray:
    """before @ step, scaled to a sum of 1 in the last axes that belong to one chunk."""
    after = before @ step
    return after / after.sum(axis=tuple(range(1, after.ndim)), keepdims=True)


def marginals(score: np.ndarray, transition: np.ndarray, count: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Marginals of the labels of texts of count words each, whose words' scores follow one another in score."""
    n, k = score.shape
    first = np.cumsum(count) - count
    many = -(-count // chunk)
    row = np.repeat(np.arange(len(count)), many)
    head = np.cumsum(many) - many  # a text's first chunk
    number = np.arange(len(row)) - head[row]
    begin = first[row] + number * chunk
    size = np.minimum(chunk, first[row] + count[row] - begin)
    step = np.exp(transition - transition.max())
    index = np.minimum(begin[:, None] + np.arange(chunk), n - 1)
    e = np.exp(score[index] - score[index].max(axis=2, keepdims=True))
    live = np.arange(chunk)[None, :] < size[:, None]
    # transfer[c]: what a chunk makes of the message before it; the first of a text makes the same of any
    transfer = np.broadcast_to(np.eye(k), (len(row), k, k)).copy()
    for i in range(chunk):
        after = transfer @ step
        if i == 0:
            after[number == 0] = 1.0
        after *= e[:, i, None, :]
        after /= after.sum(axis=(1, 2), keepdims=True)
        transfer = np.where(live[:, i, None, None], after, transfer)
    forward, backward = np.ones((len(row), k)), np.ones((len(row), k))  # the message before a chunk, and behind its last word
    by = np.argsort(-many, kind="stable")
    for t in range(1, int(many.max(initial=0))):
        texts = by[: np.searchsorted(-many[by], -t, "left")]
        c = head[texts] + t
        forward[c] = _step(forward[c - 1][:, None, :], transfer[c - 1])[:, 0]
        c = head[texts] + many[texts] - 1 - t
        backward[c] = _step(backward[c + 1][:, None, :], transfer[c + 1].transpose(0, 2, 1))[:, 0]
    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = forward
    for i in range(chunk):
        after = now @ step
        if i == 0:
            after[number == 0] = 1.0
        after *= e[:, i]
        now = alpha[:, i] = after / after.sum(axis=1, keepdims=True)
    now = backward
    for i in range(chunk - 1, -1, -1):
        beta[:, i] = now
        after = (now * e[:, i]) @ step.T
        now = np.where(live[:, i, None], after / after.sum(axis=1, keepdims=True), now)
    alpha *= beta
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha[live]


class Field:
    """A trained field: labels, weights by feature bucket and label, lexicon weights, transitions."""

    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (text, language) of the sample."""
        rows = sorted((x, y) for x, y in rows if x and y)
        self.labels = sorted({y for _, y in rows})
        k = max(1, len(self.labels))
        self.weight = np.zeros((1 << BITS, k), np.float32)
        self.transition = np.zeros((k, k))
        self.memory: tuple[np.ndarray, np.ndarray] | None = None
        self.lexicon_keys, self.lexicon_bits = np.zeros(0, np.uint64), np.zeros((0, k), np.float32)
        self.lexicon_weight = np.zeros((k, k), np.float32)
        if rows:
            self._train(rows)

    def _train(self, rows: list[tuple[str, str]]) -> None:
        rng = np.random.RandomState(_SEED)
        body, at = K.texts(pa.array([x for x, _ in rows]))
        words = Words(body, at)
        label = np.array([self.labels.index(y) for _, y in rows])
        first = np.cumsum(words.count) - words.count
        self._make_lexicon(words, label)
        pieces: list[tuple[int, int, int]] = []  # stretches of one document
        for d in range(len(rows)):
            a, stop = first[d], first[d] + words.count[d]
            while a < stop:
                b = min(stop, a + rng.randint(3, 30))
                pieces.append((a, b, label[d]))
                a = b
        # half of the stretches stay with the next of their document, the others are shuffled: switches are learned too
        order = np.arange(len(pieces))
        some = np.flatnonzero(rng.rand(len(pieces)) < 0.5)
        order[some] = rng.permutation(some)
        index = np.concatenate([np.arange(pieces[i][0], pieces[i][1]) for i in order]) if pieces else np.zeros(0, np.int64)
        gold = np.concatenate([np.full(pieces[i][1] - pieces[i][0], pieces[i][2]) for i in order]) if pieces else np.zeros(0, np.int64)
        if not len(index):
            return
        width = min(32, len(index))
        chains = -(-len(index) // width)
        size = np.full(chains, width)
        size[-1] = len(index) - width * (chains - 1)
        index, gold = (np.append(x, np.repeat(x[-1:], width * chains - len(x))) for x in (index, gold))
        bucket, who = features(body, words.start[index], words.end[index], words.total)
        by = np.argsort(who, kind="stable")
        bucket, who = bucket[by], who[by]
        edge = np.searchsorted(who, np.arange(len(index) + 1))
        count = np.maximum(np.diff(edge), 1)
        lex = self._lexicon_of(words.hash[index])
        k = len(self.labels)
        square, square_t, square_l = np.full(self.weight.shape, 1e-3, np.float32), np.full((k, k), 1e-3), np.full((k, k), 1e-3)
        batch = 16
        for _ in range(EPOCHS):
            for c in np.array_split(rng.permutation(chains), max(1, chains // batch)):
                at_word = (c[:, None] * width + np.arange(width)).ravel()
                many = edge[at_word + 1] - edge[at_word]
                own = np.repeat(np.arange(len(at_word)), many)
                pick = np.repeat(edge[at_word], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                f = bucket[pick]
                share = (1.0 / np.sqrt(count[at_word]))[own]
                emission = np.zeros((len(at_word), k))
                for y in range(k):
                    emission[:, y] = np.bincount(own, weights=self.weight[f, y] * share, minlength=len(at_word))
                emission += lex[at_word] @ self.lexicon_weight
                emission = emission.reshape(len(c), width, k)
                marginal, _ = forward_backward(emission, self.transition, size[c])
                truth = np.zeros_like(marginal)
                g = gold[at_word].reshape(len(c), width)
                np.put_along_axis(truth, g[:, :, None], 1.0, axis=2)
                live = np.arange(width)[None, :] < size[c][:, None]
                error = ((truth - marginal) * live[:, :, None]).reshape(-1, k)
                # expected transitions are taken from the product of neighbouring marginals through the field's own step
                pair = self._pairs(emission, size[c])
                seen = np.zeros((k, k))
                np.add.at(seen, (g[:, :-1][live[:, 1:]], g[:, 1:][live[:, 1:]]), 1.0)
                grad_t = (seen - pair) / len(c)
                square_t += grad_t**2
                self.transition += RATE * grad_t / np.sqrt(square_t)
                grad_l = lex[at_word].T @ error / len(c)
                square_l += grad_l**2
                self.lexicon_weight += (RATE * grad_l / np.sqrt(square_l)).astype(np.float32)
                cells, where = np.unique(f, return_inverse=True)
                for y in range(k):
                    grad = np.bincount(where, weights=error[own, y] * share, minlength=len(cells)) / len(c) - DECAY * self.weight[cells, y]
                    square[cells, y] += grad**2
                    self.weight[cells, y] += RATE * grad / np.sqrt(square[cells, y])

    def _pairs(self, emission: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Expected transitions, from scaled forward and backward messages."""
        e = np.exp(emission - emission.max(axis=2, keepdims=True))
        step = np.exp(self.transition)
        words = e.shape[1]
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for i in range(words):
            now = e[:, i] if i == 0 else (alpha[:, i - 1] @ step) * e[:, i]
            alpha[:, i] = now / now.sum(axis=1, keepdims=True)
        for i in range(words - 2, -1, -1):
            back = (beta[:, i + 1] * e[:, i + 1]) @ step.T
            beta[:, i] = np.where((i + 1 < size)[:, None], back / back.sum(axis=1, keepdims=True), 1.0)
        total = np.zeros_like(step)
        for i in range(1, words):
            p = alpha[:, i - 1, :, None] * step[None] * (e[:, i] * beta[:, i])[:, None, :]
            total += (p / p.sum(axis=(1, 2), keepdims=True))[i < size].sum(axis=0)
        return total

    def _make_lexicon(self, words: Words, label: np.ndarray) -> None:
        k = len(self.labels)
        lists = []
        for y in range(k):
            h, n = np.unique(words.hash[label[words.row] == y], return_counts=True)
            lists.append(set(h[np.lexsort((h, -n))[:LEXICON]].tolist()))
        keys = np.array(sorted(set().union(*lists)), np.uint64)
        self.lexicon_keys = keys
        self.lexicon_bits = np.array([[float(h in s) for s in lists] for h in keys.tolist()], np.float32).reshape(len(keys), k)
        self.lexicon_weight = np.zeros((k, k), np.float32)

    def _lexicon_of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.lexicon_keys):
            return np.zeros((len(h), len(self.labels)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon_keys, h), len(self.lexicon_keys) - 1)
        return np.where((self.lexicon_keys[at] == h)[:, None], self.lexicon_bits[at], np.float32(0))

    def emissions(self, body: np.ndarray, words: Words) -> np.ndarray:
        """Scores of every label for every word; equal words are looked at once."""
        kinds, sample, which = np.unique(words.hash, return_index=True, return_inverse=True)
        known = np.zeros(len(kinds), bool)
        score = np.zeros((len(kinds), len(self.labels)), np.float32)
        if self.memory is not None and len(kinds):  # frequent words of the slices before
            keys, values = self.memory
            at = np.minimum(np.searchsorted(keys, kinds), len(keys) - 1)
            known = keys[at] == kinds
            score[known] = values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            s = sample[new]
            bucket, who = features(body, words.start[s], words.end[s], words.total)
            share = (1.0 / np.sqrt(np.maximum(np.bincount(who, minlength=len(new)), 1)))[:, None]
            got = np.stack([np.bincount(who, weights=self.weight[bucket, y], minlength=len(new)) for y in range(len(self.labels))], axis=1)
            score[new] = got * share + self._lexicon_of(kinds[new]) @ self.lexicon_weight
            if self.memory is None or len(self.memory[0]) < 300_000:
                keys = kinds if self.memory is None else np.concatenate((self.memory[0], kinds[new]))
                values = score if self.memory is None else np.concatenate((self.memory[1], score[new]))
                order = np.argsort(keys)
                self.memory = keys[order], values[order]
        return score[which]

    def __getstate__(self):
        return self.__dict__ | {"memory": None}

    def label(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label of each word, its marginal, words by text) of the lower-cased texts body[at[i]:at[i + 1]]."""
        words = Words(body, at)
        n = len(words.start)
        if not n or not self.labels:
            return np.zeros(n, np.int64), np.zeros(n), words.count
        score = self.emissions(body, words)
        label, sure = np.zeros(n, np.int64), np.zeros(n)
        for i, j in K.slices(np.concatenate(([0], np.cumsum(words.count))), 200_000):
            a, b = words.count[:i].sum(), words.count[:j].sum()
            if a < b:
                marginal = marginals(score[a:b].astype(np.float64), self.transition, words.count[i:j])
                label[a:b] = marginal.argmax(axis=1)
                sure[a:b] = marginal.max(axis=1)
        return label, sure, words.count


def _runs(label: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, words, runs by row) of the runs of equal labels inside each row."""
    if not len(label):
        return label, np.zeros(0, np.int64), np.zeros(rows, np.int64)
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return label[at], np.diff(np.append(at, len(label))), np.bincount(row[at], minlength=rows)


_NEW = ("n_words", "language", "share", "confidence", "runs")
_OUT = "n_words bigint, language string, share double, confidence double, runs array<struct<lang:string,words:int>>"


def _label(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        names = pa.array(field.labels, pa.string())
        k = max(1, len(field.labels))
        for batch in batches:
            body, at = K.texts(batch.column(0))
            for i, j in K.slices(at):
                label, sure, count = field.label(body[at[i] : at[j]], at[i : j + 1] - at[i])
                rows = j - i
                row = np.repeat(np.arange(rows), count)
                table = np.bincount(row * k + label, minlength=rows * k).reshape(rows, k) if field.labels else np.zeros((rows, 1), np.int64)
                best = table.argmax(axis=1)
                some = (count > 0) & bool(field.labels)
                share = np.round(table[np.arange(rows), best] / np.maximum(count, 1), 6)
                confidence = np.round(np.bincount(row, weights=sure, minlength=rows) / np.maximum(count, 1), 6)
                if field.labels:
                    lang, words, runs = _runs(label, row, rows)
                else:
                    lang, words, runs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
                language = pa.array(np.where(some, best, 0), mask=~some)
                language = names.take(language) if field.labels else pa.nulls(rows, pa.string())
                struct = pa.StructArray.from_arrays([names.take(pa.array(lang)), pa.array(words, pa.int32())], names=["lang", "words"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(runs))), pa.int32()), struct)
                own = batch.slice(i, rows)
                yield pa.RecordBatch.from_arrays([*own.columns[1:], pa.array(count.astype(np.int64)), language, pa.array(share), pa.array(confidence), lists], names=[*own.schema.names[1:], *_NEW])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Field:
    """A field of at most ``sample`` documents with a language, those with the smallest id hashes.

    The ids are chosen first, so only the sample's texts are moved. They are trained on whole. Rows with a null id, text
    or language are left out; where an id has several texts or languages, the greatest counts.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
    chosen = src.select(F.col("id").alias("chosen")).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(sample)
    rows = src.join(small_enough(save(chosen, "language-sample"), sample), F.col("id") == F.col("chosen"))
    rows = rows.groupBy("id").agg(F.max(F.struct("text", "lang")).alias("r")).select("r.text", "r.lang")
    return Field([(r.text, r.lang) for r in rows.collect()])


def label_words(docs: DataFrame, field: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with ``n_words``, ``language``, ``share``, ``confidence`` and ``runs``.

    ``runs`` has the label of every word as runs of equal labels, in order. ``language`` is the label of most words (the
    first in alphabetical order at a tie), ``share`` their part of all words, ``confidence`` the mean marginal of the
    labels.

    A null, empty or wordless text has no language, 0 words, a share and confidence of 0 and no runs. Texts of any length
    are read whole. Columns of docs with one of the five names are replaced; the others stay, as do repeated rows. An
    empty table stays empty; without any training text no word has a label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return through_arrow(docs, text_col, keep, _label(shared), _OUT)
