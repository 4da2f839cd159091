import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from sluicework.llm import kernels as K
from sluicework.llm import language_id as L

WORDS = {
    "en": "the and with thing there would house other which their between morning water".split(),
    "de": "der und nicht schön zwischen straße haus wasser morgen anderer welche über kein".split(),
    "es": "el los pero niño entre calle casa agua mañana otros cuál según ningún".split(),
}


def text(rng, lang, n):
    ends = {"en": ["ing", "ed", "ly", ""], "de": ["ung", "keit", "en", ""], "es": ["ción", "mente", "ado", ""]}[lang]
    return [rng.choice(WORDS[lang]) + rng.choice(ends) for _ in range(n)]


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    return L.Field([(" ".join(text(rng, g, 60)), g) for _ in range(40) for g in WORDS])


def test_forward_backward_by_enumeration():
    rng = np.random.RandomState(3)
    e, t = rng.randn(2, 4, 3), rng.randn(3, 3)
    got, log_z = L.forward_backward(e, t, np.array([4, 3]))
    for c, n in enumerate((4, 3)):
        total, marginal = 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(e[c, i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                marginal[i, y] += p
        assert np.allclose(got[c, :n], marginal / total) and np.isclose(log_z[c], np.log(total))


def test_code_switched_text(field):
    rng = random.Random(7)
    texts, gold = [], []
    for _ in range(60):
        words = []
        for _ in range(5):
            g = rng.choice(list(WORDS))
            part = text(rng, g, rng.randint(4, 15))
            words += part
            gold += [field.labels.index(g)] * len(part)
        texts.append(" ".join(words))
    body, at = K.texts(pa.array(texts))
    label, sure, count = field.label(body, at)
    assert len(label) == len(gold) and (label == np.array(gold)).mean() > 0.93 and (sure <= 1 + 1e-9).all()


@pytest.mark.parametrize("chunk", [1, 2, 7, 32, 500])
def test_chunks_give_the_exact_marginals(chunk):
    rng = np.random.RandomState(chunk)
    count = np.array([0, 1, 2, chunk, chunk + 1, 0, 3 * chunk, 5 * chunk + 3, 700])
    score, transition = 3 * rng.randn(count.sum(), 4), 2 * rng.randn(4, 4)
    got = L.marginals(score, transition, count, chunk)
    edge = np.concatenate(([0], np.cumsum(count)))
    for a, b in zip(edge, edge[1:]):
        if a < b:
            want, _ = L.forward_backward(score[None, a:b], transition, np.array([b - a]))
            assert np.allclose(got[a:b], want[0], atol=1e-12)


def test_long_texts_are_labelled_as_one_chain(field):
    rng = random.Random(2)
    words = [w for _ in range(60) for w in text(rng, rng.choice(list(WORDS)), 30)]
    body, at = K.texts(pa.array([" ".join(words), "der haus"]))
    label, sure, count = field.label(body, at)
    score = field.emissions(body, L.Words(body, at))
    whole, _ = L.forward_backward(score[None, : count[0]].astype(float), field.transition, np.array([count[0]]))
    assert count[0] == len(words) and (whole[0].argmax(axis=1) == label[: count[0]]).all() and np.allclose(whole[0].max(axis=1), sure[: count[0]])


def test_expected_transitions_are_the_gradient(field):
    """The partition function's numeric derivative by each transition weight."""
    rng = np.random.RandomState(1)
    k = len(field.labels)
    e, size = rng.randn(3, 6, k), np.array([6, 4, 1])
    own = L.Field([])
    own.transition = rng.randn(k, k)
    got, eps = own._pairs(e, size), 1e-6
    for a, b in itertools.product(range(k), repeat=2):
        up, down = own.transition.copy(), own.transition.copy()
        up[a, b] += eps
        down[a, b] -= eps
        slope = (L.forward_backward(e, up, size)[1].sum() - L.forward_backward(e, down, size)[1].sum()) / (2 * eps)
        assert abs(slope - got[a, b]) < 1e-5


def test_features_of_a_word():
    """Equal affixes, inner trigrams and words fall into equal buckets; others do not."""
    def of(word):
        body = np.frombuffer(word.encode(), np.uint8)
        bucket, _ = L.features(body, np.array([0]), np.array([len(body)]), K.prefix(body))
        return bucket.tolist()

    for word in ("straße", "a", "ab", "mañana", "日本語"):
        n = len(word)
        assert len(of(word)) == 1 + 2 * min(n, 4) + max(n - 2, 0)
    both = set(of("lesen")) & set(of("wesen"))
    assert len(both) == 4 + 2  # endings n, en, sen, esen and the inner ese, sen
    assert len(set(of("lesen")) & set(of("lesen"))) == len(set(of("lesen")))


def test_training_reads_whole_texts():
    """What sets the languages apart comes behind hundreds of equal words."""
    same = " ".join(["na"] * 300)
    field = L.Field([(f"{same} {w}", g) for g, w in (("en", "water house "), ("de", "wasser haus ")) for _ in range(20)])
    body, at = K.texts(pa.array(["water house", "wasser haus"]))
    label, _, _ = field.label(body, at)
    assert [field.labels[y] for y in label] == ["en", "en", "de", "de"]


def test_odd_rows(odd, none, field):
    out = {r.doc_id: r for r in L.label_words(odd, field).collect()}
    for i in (4, 5, 6):
        assert (out[i].n_words, out[i].language, out[i].share, out[i].runs) == (0, None, 0.0, [])
    assert out[8].n_words == 30_000 and sum(r.words for r in out[8].runs) == 30_000
    assert L.label_words(none, field).count() == 0
    nothing = L.fit(none)
    assert all(r.language is None for r in L.label_words(odd, nothing).collect())
    assert L.fit(odd).labels == ["en", "fr", "ja"]
