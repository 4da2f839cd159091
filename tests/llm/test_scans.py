"""Secrets, URLs, neighbours, quality."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluicework.llm import ann, bpe, quality, secrets, url_filter
from sluicework.llm import kernels as K
from sluicework.llm import queries as Q


def test_secrets(spark, odd, none):
    hexa = "1eb9c654e721b4f812088970e66a6345cee33dd6"
    rows = [
        (1, f'é token = "{hexa}" end'),
        (2, f"commit {hexa} of the tree"),
        (3, "id 123e4567-e89b-12d3-a456-426614174000 and 2024-01-02-03-04-05-06"),
        (4, "AKq8Zr3TnX0vPw7LmB2c and internationalization2000andmore"),
        (5, f"md5: {hexa} sha256={hexa}{hexa[:24]} integrity sha384-oqVuAfXRKap7fdgcCY5uykM6+R9GqQ8K/uxy9rx7HNQlGYl1kPzQho1wx4JwY8wC"),
        (6, "commit ghp_9QzX4vKpL7mWr2TyBnGh5sD8fJ3c and no digit QzXvKpLmWrTyBnGhxq"),
        (7, "password: 123e4567-e89b-12d3-a456-426614174000, " + "api_key" + " " * 300 + f"= {hexa}"),
    ]
    got = [(r.doc_id, r.start, r.secret) for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(1, 11, hexa), (4, 0, "AKq8Zr3TnX0vPw7LmB2c"), (6, 7, "ghp_9QzX4vKpL7mWr2TyBnGh5sD8fJ3c"), (6, 53, "QzXvKpLmWrTyBnGhxq"), (7, 10, "123e4567-e89b-12d3-a456-426614174000"), (7, 357, hexa)]
    assert secrets.scan_secrets(odd).count() == 0 and secrets.scan_secrets(none).count() == 0


def test_registered_secrets_against_brute_force(spark):
    """The whole table, string by string, with regular expressions and the tokenizer only."""
    enc = secrets.tokenizer(bpe.VOCABULARY)
    name = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)\w*[\"']?\s*(?:[:=]|=>)?\s*[\"']?\Z"
    digest = r"(?i)(?:md5|sha-?\d{0,3}|digest|checksum|integrity|commit|etag|hash|revision|blob)\w*[\"']?\s*[:=\-(]*\s*[\"']?\Z"
    sf_dir, want = "/root/testdata/sf0.01", []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for m in re.finditer(r"[A-Za-z0-9_\-+/=]{16,}", r.text or ""):
            begin = m.start() + m[0].rstrip("=").rfind("=") + 1
            rest = r.text[begin : m.end()]
            word = rest.strip("=-/+_")
            if len(word) < 16 or not re.search("[A-Za-z]", word):
                continue
            front, tokens = r.text[:begin], len(enc.encode_ordinary(word))
            if len(word) / tokens >= (2.2 if re.search("[0-9]", word) else 1.8):
                continue
            if not re.search(name, front):
                plain = re.sub(r"(?i)^0x", "", word)
                if re.fullmatch(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", word) or (re.fullmatch("(?i)[0-9a-f]+", plain) and len(plain) in (32, 40, 56, 64, 96, 128)):
                    continue
                bare = re.sub(r"(?i)^sha-?\d{1,3}-", "", word)
                if len(bare) in (22, 27, 38, 43, 64, 86) and (bare != word or re.search(digest, front)):
                    continue
            want.append((r.doc_id, begin + rest.index(word), word, tokens, round(len(word) / tokens, 6)))
    got = [tuple(r) for r in Q.op2_secrets(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(got) > 10


def test_urls(spark):
    urls = ["https://casino-win.example.com", "http://www.freebets.com", "https://free-bets.example.com/", "http://a.b/winter", "http://CASINO.com", "", None, "http://x/free/free", "http://x/" + "a" * 50_000 + "/pills", "free.win", "casinoé", "http://x/%63asino", "http://x/%46ree/w%69n", "http://x/%zz/free%20win", "http://x/%e9free", "%%361"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, terms string"))
    for r in out.collect():
        u = re.sub("%(3[0-9]|[46][1-9a-f]|[57][0-9a])", lambda m: chr(int(m[1], 16)).lower(), (urls[r.page_id] or "").lower())
        hit = {t for t in (*url_filter.STRICT, *url_filter.SOFT) if re.search(f"(^|[^a-z0-9]){t}($|[^a-z0-9])", u)}
        assert r.terms == ",".join(sorted(hit))
        assert r.rejected == (bool(hit & set(url_filter.STRICT)) or len(hit - set(url_filter.STRICT)) >= 2)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_neighbours(spark):
    rng = np.random.RandomState(4)
    x = rng.randn(1500, 32)
    x[:200] = x[0] + 0.01 * rng.randn(200, 32)  # a dense group
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(-7, [1.0], 1), (5, x[5].tolist(), 1), (None, x[0].tolist(), 1), (2000, None, 1), (2001, [0.0] * 32, 1), (2002, [1.0], 1), (2003, [float("nan")] * 32, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest_neighbours(df, shard=800, slice_rows=500, pivots=256).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.cosine)
    assert sorted(got) == list(range(1500)) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -9)
    least = np.sort(s, axis=1)[:, -10]
    hits = sum(s[i, n] >= least[i] - 1e-5 for i, v in got.items() for n, _ in v.values())
    assert hits / 15000 >= 0.9
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.rank, r.neighbour_id) for r in ann.nearest_neighbours(few).collect()) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert ann.nearest_neighbours(few.limit(0)).count() == 0
    assert {r.vec_id for r in ann.nearest_neighbours(few, every=2).collect()} == {2} and ann.nearest_neighbours(few, every=5).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_neighbours_against_brute_force(spark, sf):
    """The query with its own parameters: recall, exact cosines, and every query has its k neighbours."""
    sf_dir = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in Q.op3_nearest_neighbours(spark, sf_dir).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.cosine)
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    place, hits = {i: k for k, i in enumerate(ids.tolist())}, 0
    for i, v in got.items():
        s = x @ x[place[i]]
        s[place[i]] = -9
        least = np.sort(s)[-10]
        assert sorted(v) == list(range(1, 11)) and [c for _, c in sorted(v.values(), key=lambda y: -y[1])] == [v[r][1] for r in range(1, 11)]
        assert all(abs(s[place[n]] - c) < 1e-5 for n, c in v.values())
        hits += sum(c >= least - 1e-5 for _, c in v.values())
    assert hits / (10 * len(got)) >= 0.9


def test_footrule():
    rng = np.random.RandomState(1)
    order = np.array([rng.permutation(20)[:6] for _ in range(30)], np.uint16)
    got = ann.InvertedFiles(order, 20).shared(order)
    m = 6
    place = np.full((30, 20), m)
    for i, o in enumerate(order):
        place[i, o] = np.arange(m)
    foot = np.abs(place[:, None, :] - place[None]).sum(axis=2)
    assert (foot == m * (m + 1) - 2 * got.astype(int)).all()


def test_quality(spark, odd, none):
    good = [f"a calm sentence about rivers and hills number {i % 9}, written with care and read with joy by many" for i in range(150)]
    bad = [f"buy### now%%% cheap*** stuff$$$ click&&& here### offer%%% {i % 9}" for i in range(50)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, docs.where("doc_id < 150"))
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert all(got[i].keep for i in range(150)) and not any(got[i].keep for i in range(150, 200))
    # the same scores, n-gram by n-gram
    body, at = K.texts(pa.array([t for _, t in rows]))
    for i in (0, 77, 160):
        own = body[at[i] : at[i + 1]]
        total = sum(model.ratios[b].sum() for b, _ in quality.buckets(own, np.array([0, len(own)])))
        n = 2 * len(rows[i][1].split()) - 1
        assert got[i].n_grams == n and abs(got[i].score - total / (n + quality.SHRINK)) < 1e-6
    raw = np.zeros(1 << quality.BITS)
    for b, _ in quality.buckets(body, at):
        raw += np.bincount(b, minlength=len(raw))
    assert raw.sum() == sum(2 * len(t.split()) - 1 for _, t in rows)
    out = {(r.doc_id, r.keep) for r in quality.score_quality(odd, model).collect()}
    assert {(4, False), (5, False), (6, False)} <= out
    nothing = quality.fit(none, none)
    assert quality.score_quality(none, nothing).count() == 0 and all(r.keep for r in quality.score_quality(docs, nothing).collect())


def test_registered_quality_from_its_definition(spark):
    """Counts, ratios, threshold and every score of the table in plain Python; only the bucket of an n-gram is the operator's."""
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and doc_id is not null").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.HOLD_OUT)).alias("part")).distinct()
    held = {r.doc_id: r.part == 0 for r in labels.collect()}
    assert len(held) <= quality.TRUSTED
    texts = [(i, re.findall("[^ \t\r\n\f\v\0]+", (t or "").lower())) for i, t in docs]
    own = [(i, [*w, *([" ".join(w)] if len(w) == 1 else map(" ".join, zip(w, w[1:])))], len(w)) for i, w in texts]
    vocabulary = sorted({(g, k < n) for _, grams, n in own for k, g in enumerate(grams)})
    body, at = K.texts(pa.array([g for g, _ in vocabulary]))
    one, two = quality.buckets(body, at)
    unigram, bigram = (dict(zip(row.tolist(), b.tolist())) for b, row in (one, two))
    place = {v: (unigram if v[1] else bigram)[k] for k, v in enumerate(vocabulary)}
    raw, target = Counter(), Counter()
    for i, grams, n in own:
        for k, g in enumerate(grams):
            raw[place[g, k < n]] += 1
            target[place[g, k < n]] += held.get(i) is False
    total, size = sum(target.values()), 1 << quality.BITS
    ratio = lambda b: math.log((1 - quality.BLEND) * target[b] / total / ((raw[b] + 1) / (sum(raw.values()) + size)) + quality.BLEND)
    score = [(i, len(grams), round(sum(ratio(place[g, k < n]) for k, g in enumerate(grams)) / (len(grams) + quality.SHRINK), 6)) for i, grams, n in own]
    low, middle = np.quantile([s for i, n, s in score if held.get(i) and n], (0.01, 0.5))
    threshold = low - quality.MARGIN * (middle - low)
    got = {r.doc_id: r for r in Q.op6_quality(spark, sf_dir).collect()}
    assert len(got) == len(score) > 100 and 0 < sum(r.keep for r in got.values()) < len(got)
    for i, n, s in score:
        assert got[i].n_grams == n and abs(got[i].score - s) < 3e-6
        if abs(s - threshold) > 1e-5:
            assert got[i].keep == (n > 0 and s >= threshold)
