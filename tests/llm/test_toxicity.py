import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sluicework.llm import kernels as K
from sluicework.llm import queries as Q
from sluicework.llm import toxicity as T
from sluicework.llm.common import table


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    words = ["the", "and", "house", "river", "green", "walking", "people", "stuff", "button", "letter", "morning", "good", "clear", "street"]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if i % 8 == 0:
            for w in ("idiot", "moron", "trash"):
                text[rng.randrange(len(text))] = w
        rows.append((" ".join(text), int(i % 8 == 0)))
    return T.Model(rows)


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("t r a s h", "trash"), ("tr@sh", "trash"), ("moooron", "moron"), ("m.o.r.o.n", "moron"), ("id*ot", "idiot")])
def test_restores(model, token, word):
    assert list(T.suspects(f"so {token} it")) == [(3, 3 + len(token))]
    assert model.restore(token) == word
    clean = "the green house and the river " * 2
    assert model.score_one(clean)[0] < 0 < model.score_one(clean + f"{token} {token} {token}")[0]


def test_plain_words_stay(model):
    assert list(T.suspects("button letter good 2024 a-b, street")) == []
    assert model.restore("good") == "good"


def test_batches_equal_single_texts(model):
    rng = random.Random(9)
    bits = ["the ", "1d10t ", "é", "trash", "—", "x", "t r a s h ", "\n", "aaa", "日日日", "ñ.ñ.ñ.ñ", "5", "moron!", "🙂", "$tuff", "m0ron "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    body, at = K.texts(pa.array(texts))
    score, hits, hidden = model.score(body, at)
    for t, a, b, c in zip(texts, score, hits, hidden):
        want = model.score_one(t)
        assert abs(want[0] - a) < 1e-9 and want[1:] == (b, c), t
    assert np.sum(hidden) > 20


def test_odd_rows(odd, none, model):
    out = T.score_toxicity(odd, model)
    assert [c for c in out.columns if c in ("score", "toxic", "hits", "hidden")] == ["score", "hits", "hidden", "toxic"]
    assert not any(r.toxic for r in out.collect())
    assert T.score_toxicity(none, model).count() == 0
    labels = odd.sparkSession.createDataFrame([(1, 0), (9, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    fitted = T.fit(odd, labels)
    assert T.fit(none, labels.limit(0)).score_one("any words")[0] <= 0 and fitted.prior == 0.0


@pytest.mark.parametrize("token,words", [(" ".join("themoronandgoodidiot" * 3), ["moron", "idiot"] * 3), (" ".join("trashidiot"), ["trash", "idiot"]), ("t" + "r" * 60 + "ash", ["trash"])])
def test_long_spans(model, token, words):
    assert list(T.suspects(f"so, {token}, it")) == [(4, 4 + len(token))]
    assert [w for w in model.restore(token).split() if model.of(w) > 0] == words
    body, at = K.texts(pa.array([f"so, {token}, it"]))
    assert [int(x[0]) for x in model.score(body, at)[1:]] == [len(words)] * 2


def test_decoding_is_linear(model):
    assert model.restore("idiot" + " x" * 100_000).startswith("idiot") and model.restore("id" + "i" * 200_000 + "ot") == "idiot"


@pytest.mark.parametrize("token", ["trrash", "iddiot", "6i8 iddiot", "*oron", "#diot", "idio+", "m0ron$", "tra$h!", "id.iot", "mo ron", "mo-r-on", "id_i_ot", "idi*t", "1diot99"])
def test_hidden_words(model, token):
    clean = "the green house and the river "
    texts = [f"so, {token}, it", clean + token, clean]
    body, at = K.texts(pa.array(texts))
    score, hits, hidden = model.score(body, at)
    assert list(hidden) == [1, 1, 0], [model.restore(token)]
    assert [(round(a, 6), b, c) for a, b, c in zip(score, hits, hidden)] == [(round(a, 6), b, c) for a, b, c in map(model.score_one, texts)]


def test_words_that_open_none_are_not_joined(model, monkeypatch):
    """Neighbouring words are joined only as far as a word with a weight begins like them."""
    asked = []

    class Asked(dict):
        def __contains__(self, f):
            asked.append(f)
            return super().__contains__(f)

    monkeypatch.setattr(model, "weight", Asked(model.weight))
    assert list(model.plain("a b c d e f g h " * 20)) == [] and asked == []
    assert list(model.plain("we say mo ron here")) == [("mo ron", "moron")] and asked == ["=moron"]


def test_only_tokens_that_may_hide_a_word_are_decoded(model, monkeypatch):
    """A token without a path to a word with a weight isn't decoded; what suspects gain is the same as with all decoded."""
    decoded, viterbi = [], T.viterbi
    monkeypatch.setattr(T, "viterbi", lambda token, c: decoded.append(token) or viterbi(token, c))
    for part in ("memory", "gains", "doubled"):
        monkeypatch.setattr(model, part, {}, raising=False)
    model.score(*K.texts(pa.array(["a house! 4 gr33n riv3r at 7a2f, b b b and hellooo", "so 1d10t it"])))
    assert decoded == ["1d10t"]
    rng = random.Random(4)
    tokens = ["ab\u16801d10t", "m0r0n\u1680x", "**1d10t**", "x.m.0.r.0.n", "*#o*on", "trashhh1", "idiotic0"]
    tokens += ["".join(rng.choice("idotmrnashx10@$*#. é") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    tokens += ["".join(rng.choice(c + {"o": "0", "i": "1", "a": "@", "s": "$"}.get(c, c)) for c in w) for w in ("idiot", "moron", "trash", "xmoronx") * 50]
    gains = [model._gain(t, model.restore(t)) for t in tokens]
    assert [model._suspect_gain(t) for t in tokens] == gains and sum(h > 0 for _, h in gains) > 100


def test_suspects_of_many_texts(model):
    """The spans found with array operations are those of `suspects`, and batches with cut, doubled and spelled-out words score as single texts do."""
    rng = random.Random(8)
    bits = ["a", "b ", "é", "éé", "日", " ", ".", "-", "*", "**", "0", "1", "@", "!", "+", "aaa", "bb", "ж", "жжж", "—", "🙂", "\n", "\u1680", " a b c", " m.o.r.o.n", "mo ron ", "id iot", " tra-sh-", "trrash ", "iddiot", "1d10t", "moron "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    body, at = K.texts(pa.array(texts))
    begins = (body & 0xC0) != 0x80
    start, end, row = T._suspect_spans(body, at, T.letters(body), np.append(np.flatnonzero(begins), len(body)), np.cumsum(begins) - 1)
    got = [(r, body[a:b].tobytes().decode(), a - at[r]) for a, b, r in zip(start, end, row)]
    assert got == [(r, t[a:b], len(t[:a].encode())) for r, t in enumerate(texts) for a, b in T.suspects(t)] and len(got) > 5000
    for t, a, b, c in zip(texts, *model.score(body, at)):
        want = model.score_one(t)
        assert abs(want[0] - a) < 1e-9 and want[1:] == (b, c), t


@pytest.mark.parametrize("most", [1, 200, 1 << 22])
def test_counts_by_definition(monkeypatch, most):
    """Tokens and texts of each word and beginning, in slices of any size."""
    monkeypatch.setattr(T, "COUNTED", most)
    rng = random.Random(3)
    bits = ["idiotic", "Idiots", "ñandúes", "日本語の文字列", "a", "ab1cd", "--", " ", "\n", "ΣΑΣ", "İx", "🙂", "thousand", "thou"]
    rows = [(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 15))), rng.randint(0, 1)) for _ in range(150)] + [(None, 1), ("", 0)]
    want, words = {}, [1.0, 1.0]
    for text, t in rows:
        found = T._WORD.findall((text or "").lower())
        words[t] += len(found)
        for k, fs in ((t, [f for w in found for f in T.features(w)]), (2 + t, {f for w in found for f in T.features(w)})):
            for f in fs:
                want.setdefault(f, [0, 0, 0, 0])[k] += 1
    got = T._Counts(rows)
    assert got.of == want and got.words == words and got.sizes == [sum(t == k for _, t in rows) for k in (0, 1)]


def test_short_spelled_word():
    small = T.Model([("you are an ass " + "plain words here " * 5, 1)] * 40 + [("you are fine as plain words here " * 5, 0)] * 200)
    body, at = K.texts(pa.array(["you are an a s s", "you are an a$$", "you are an as"]))
    assert list(small.score(body, at)[2]) == [1, 1, 0]


def test_viterbi_by_enumeration(model):
    """The best of all paths through a small lattice, each path's probability by the formula."""
    c = model.characters
    for token in ("m0r", "1d*", "t.r", "aa", "$4e", "g++d"):
        best, word = -1e9, None
        for path in itertools.product(*T.lattice(token)):
            total, before = 0.0, "^^"
            for x, cost in path:
                total += cost
                if x == " ":
                    total, before = total + c(before, "\0"), "^^"
                elif x:
                    total, before = total + c(before, x), before[1] + x
            total += c(before, "\0")
            if total > best:
                best, word = total, "".join(x for x, _ in path)
        assert T.viterbi(token, c) == word


def test_weights_by_hand():
    """Counts, log odds and the likelihood ratio statistic of a small sample, from their definitions."""
    rows = [("calm river stones", 0)] * 30 + [("calm idiotic words here", 1)] * 10
    got = T.Model(rows)
    words = (1 + 90, 1 + 40)
    want = {}
    for word in ("idiotic", "words", "here"):
        for f in ("=" + word, *("<" + word[:n] for n in (4, 5, 6, 7) if len(word) > n)):
            weight = math.log((10 + 0.5) / words[1] / (0.5 / words[0]))
            table = [(10, 10, 0.25), (0, 10, 0.75), (0, 30, 0.25), (30, 30, 0.75)]
            statistic = 2 * sum(n * math.log(n / (size * q)) for n, size, q in table if n)
            assert abs(T._association(10, 10, 0, 30) - statistic) < 1e-9
            if weight >= T.MIN_WEIGHT and statistic >= T.MIN_ASSOCIATION:
                want[f] = weight
    assert got.weight.keys() == want.keys() and len(want) == 3 + 3 + 1
    assert all(abs(got.weight[f] - w) < 1e-12 for f, w in want.items())
    assert abs(got.prior - math.log(11 / 31)) < 1e-12 and abs(got.cost - 30 / 41) < 1e-12


def test_fit_takes_every_labelled_text(spark, monkeypatch):
    """More texts than any sample once took: the counts by tasks are those of all texts, with several labels and texts of an id."""
    monkeypatch.setattr(T, "COUNTED", 30)
    rng = random.Random(6)
    words = [a + b for a in ("ca", "ri", "sto", "mo", "ble") for b in ("lm", "ver", "nes", "rning", "tt", "éa")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)) + (" idiotic scum" if i % 9 == 0 and i >= 4500 else "")) for i in range(5000)]
    flags = [(i, int(i % 9 == 0)) for i in range(5000)]
    docs = spark.createDataFrame([*rows, (9, "a first text"), (None, "scum"), (7000, "no label")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([*flags, (10, 1), (11, None), (None, 1)], "doc_id long, toxic int")
    text, flag = dict(rows), dict(flags) | {10: 1}
    text[9] = max(text[9], "a first text")
    want = T.Model([(text[i], flag[i]) for i in text])
    got = T.fit(docs, labels)
    assert want.weight.keys() == got.weight.keys() >= {"=idiotic", "=scum", "<idio"}
    assert all(abs(got.weight[f] - w) < 1e-12 for f, w in want.weight.items())
    assert abs(got.cost - want.cost) < 1e-12 and abs(got.prior - want.prior) < 1e-12
    a, b = got.characters, want.characters
    assert a.sizes == b.sizes and a.three.keys() == b.three.keys() and a.one.keys() == b.one.keys()
    assert all(abs(a.three[k] - v) < 1e-9 for k, v in b.three.items()) and all(abs(a.two[k] - v) < 1e-9 for k, v in b.two.items())
    assert all(abs(a.log_word(w) - p) < 1e-9 for w, p in b.word.items()) and a.log_word("unknown") is None
    for token in ("1d10tic", "s c u m", "r i v e r s t o n e s"):
        assert got.restore(token) == want.restore(token)


def test_character_model_by_hand():
    c = T.CharacterModel({"ab": 3.0, "ac": 1.0})
    assert abs(c("^^", "a") - math.log(0.7 * 1 + 0.2 * 1 + 0.1 * 4 / 12 + 1e-6)) < 1e-12
    assert abs(c("^a", "b") - math.log(0.7 * 0.75 + 0.2 * 0.75 + 0.1 * 3 / 12 + 1e-6)) < 1e-12
    assert abs(c("^a", "z") - math.log(1e-6)) < 1e-12


def test_registered_scores_one_by_one(spark, sf_dir):
    """Every document of the table, word by word."""
    docs = table(spark, sf_dir, "documents")
    model = T.fit(docs, table(spark, sf_dir, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = Q.op5_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        score, hits, hidden = model.score_one(texts[r.doc_id])
        assert abs(score - r.score) < 2e-6 and (hits, hidden) == (r.hits, r.hidden) and r.toxic == (r.score > 0)
