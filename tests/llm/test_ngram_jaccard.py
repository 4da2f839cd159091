import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sluicework.llm import ngram_jaccard
from sluicework.llm.ngram_jaccard import components, local_roots, near_duplicates, ngram_jaccard_join


def grams(text, n=3):
    words = re.findall("[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute(rows, t=ngram_jaccard.THRESHOLD):
    """(class, links) of each id, from all pairs of documents."""
    one = {i: frozenset() for i, _ in rows if i is not None}
    for i, text in rows:
        if i is not None and (g := grams(text)):
            one[i] = g
    root, links = {i: i for i in one}, dict.fromkeys(one, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = sorted(one.items())
    for k, (a, x) in enumerate(items):
        for b, y in items[k + 1 :]:
            if x and y and len(x & y) / len(x | y) >= t:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (find(i), links[i]) for i in one}


def as_dict(df):
    rows = df.collect()
    out = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert len(out) == len(rows)
    return out


def edited(rng, n):
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(n):
        if i % 3 == 0 or not rows:
            text = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        else:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows


def test_random_edits(spark):
    rows = edited(random.Random(3), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_dict(ngram_jaccard_join(docs, threshold=0.8)) == brute(rows, 0.8)
    want = brute(rows)
    assert as_dict(ngram_jaccard_join(docs)) == want
    assert sum(n for _, n in want.values()) > 60 and len({c for c, _ in want.values()}) > 20


@pytest.mark.parametrize("block", [2, 7])
def test_hot_groups_are_split_without_loss(spark, monkeypatch, block):
    """Small blocks: the same join in many cells."""
    monkeypatch.setattr(ngram_jaccard, "GROUP_BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "LIST_BLOCK", block)
    rng = random.Random(8)
    base = [f"v{i}" for i in range(40)]
    rows = edited(rng, 60)
    for i in range(60, 110):  # near copies of one text, and copies of those
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(40)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    rows += [(i + 100, t) for i, t in rows[-20:]]
    want = brute(rows)
    assert as_dict(ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want
    assert max(n for _, n in want.values()) > 30


def crowded():
    """Two crowds of edited copies, copies of those, a text between the crowds, and texts with a shared line."""
    rng = random.Random(5)
    bases = [[f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]]
    rows = edited(rng, 40)
    for i in range(40, 160):
        text = list(bases[i % 2])
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    rows += [(i + 200, t) for i, t in rows[-12:]] + [(400, " ".join(bases[0] + bases[1])), (401, " ".join(bases[0][:45]))]
    rows += [(500 + i, " ".join([rng.choice("pqrstuvw") + str(rng.randrange(90)) for _ in range(50)] + ["all", "rights", "are", "reserved", "here"])) for i in range(30)]
    return rows + rows[60:64] + [(61, "another text of this id")]


@pytest.mark.parametrize("block", [7, 1024])
def test_crowds_are_compared_whole(spark, monkeypatch, block):
    for name, value in (("CROWD", 5), ("GROUP_BLOCK", block), ("LIST_BLOCK", block)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    rows = crowded()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = {}
    for i, text in rows:  # of several texts of an id the one with the smallest set key counts
        one.setdefault(i, set()).add(text)
    keys = {t: ngram_jaccard._set_key(own) for ts in one.values() if len(ts) > 1 for t in ts for _, own in ngram_jaccard.K.gram_sets(pa.array([t]), 3)}
    want = brute([(i, min(ts, key=lambda t: keys.get(t, b""))) for i, ts in one.items()])
    assert as_dict(ngram_jaccard_join(docs)) == want
    assert max(n for _, n in want.values()) > 50


def test_cut_copies_are_one_crowd(spark, monkeypatch):
    """Edited copies of one text, cut to between a third and all of it: nearly all of them are one crowd."""
    rng, found, crowds = random.Random(12), [], ngram_jaccard._crowds
    base = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(300)]
    rows = []
    for i in range(260):
        size = rng.randint(100, 300)
        at = rng.randrange(301 - size)
        rows.append((i, " ".join("e" + str(rng.randrange(10**6)) if rng.random() < 0.02 else w for w in base[at : at + size])))
    monkeypatch.setattr(ngram_jaccard, "CROWD", 16)
    monkeypatch.setattr(ngram_jaccard, "_crowds", lambda sets: found.append(crowds(sets)) or found[0])
    assert as_dict(ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
    sizes = sorted(r["count"] for r in found[0].groupBy("crowd").count().collect())
    assert sizes[-1] > 0.8 * len(rows), sizes


def test_pairs_of_a_crowd_are_not_made():
    """2,000 texts of one crowd with a common gram: no pair of them; one pair each with the text of no crowd."""
    n = 2001
    ids, crowd = np.arange(n), np.full(n, -7)
    crowd[1234] = 0
    same = np.zeros(n, np.uint32)
    got = list(ngram_jaccard._pairs_of(same, ids, np.full(n, 90, np.uint32), np.arange(n, dtype=np.uint32), same.astype(np.uint8), same.astype(np.uint8), crowd, 0.5))
    pairs = {(int(a), int(b)) for x in got for a, b in zip(x[0], x[1])}
    assert pairs == {(min(i, 1234), max(i, 1234)) for i in range(n) if i != 1234}


def test_place_roots():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, 220), rng.integers(0, 300, 220)
    nodes, root = local_roots(a, b)
    want = np.arange(300)
    want[nodes] = root
    assert list(ngram_jaccard.place_roots(300, a, b)) == list(want)


def test_rare_first():
    """The global order: by the level of the count, and levels rise with counts."""
    count = np.arange(1, 100_000)
    level = ngram_jaccard._level(count)
    assert level[0] == 0 and (np.diff(level.astype(int)) >= 0).all() and level[2**16 - 1] == 16 * ngram_jaccard.STEPS
    assert len(np.unique(level[:8])) == 8


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = as_dict(ngram_jaccard_join(odd))
    assert got == brute(rows) and got[1] == (1, 2) and got[3] == (1, 2) and got[4] == (4, 0) and got[6] == (6, 0)
    assert as_dict(ngram_jaccard_join(none)) == {}


def test_one_of_each_group_stays(odd):
    kept = near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "4", "5", "6", "None", "8", "9", "10"])


@pytest.mark.parametrize("small", [0, 100])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_jaccard, "SMALL_EDGES", small)
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (20, 21), (22, 21), (23, 22)], "a long, b long")
    got = {r.id: r.root for r in components(edges).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 9: 8, 21: 20, 22: 20, 23: 20}


def test_local_roots():
    x, y = np.array([5, 4, 3, 2, 9, 20, 22, 23]), np.array([4, 3, 2, 1, 8, 21, 21, 22])
    assert dict(zip(*map(np.ndarray.tolist, local_roots(x, y)))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20}


def test_threshold(odd):
    with pytest.raises(ValueError):
        ngram_jaccard_join(odd, threshold=0)
