import math
from collections import Counter

from sluicework.llm.mixing import mix_sources, mixed, temperature_weights


def test_weights():
    tokens = {"a": 900_000, "b": 50_000, "c": 50_000, "d": 0}
    a, w = temperature_weights(tokens, target_entropy=0.9, max_epochs=100)
    p = [x / 1e9 for x in w.values() if x]
    assert 0 < a < 1 and abs(-sum(x * math.log(x) for x in p) / math.log(3) - 0.9) < 1e-6 and w["d"] == 0
    b, w = temperature_weights(tokens, target_entropy=0.9, max_epochs=2)
    assert b > a and abs(max(w[s] / 1e9 * 1_000_000 / tokens[s] for s in "abc") - 2) < 1e-6
    assert temperature_weights({"a": 5, "b": 5})[0] == 1.0
    assert temperature_weights({})[0] == 1.0 and temperature_weights({"a": 0}) == (1.0, {"a": 0})


def test_realised(spark):
    rows = [(i, "w " * (5 + i % 7), "hot" if i % 10 else "cold" if i % 20 else "rare") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(docs, block_tokens=500).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    totals = Counter()
    for i, _, s in rows:
        totals[s] += size[i]
    _, w = temperature_weights(dict(totals))
    whole = sum(totals.values())
    real = Counter()
    for r in out:
        assert r.tokens == size[r.doc_id]
        real[r.source] += r.tokens
    for s in totals:
        budget = round(whole * w[s] / 1e9)
        assert budget <= real[s] < budget + 12
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)
    assert sorted((r.block, r.place) for r in out) == sorted((b, k + 1) for b, n in Counter(r.block for r in out).items() for k in range(n))
    share = Counter((r.block, r.source) for r in out)
    blocks = max(r.block for r in out) + 1
    assert blocks == -(-sum(round(whole * x / 1e9) for x in w.values()) // 500) and all(share[b, "hot"] for b in range(blocks))
    # the filter gives the same copies
    again = Counter(r.doc_id for r in mixed(docs).collect())
    assert again == Counter(r.doc_id for r in out) and max(again.values()) > 1 and len(again) < 600
    # and puts them into their places
    rows = mixed(docs, block_tokens=500).collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in sorted(out, key=lambda r: (r.block, r.place))]


def test_odd_rows(odd, none):
    out = mix_sources(odd).collect()
    assert {r.source for r in out} <= {"", "a", "b", "c"} and all(r.doc_id != 4 or r.tokens == 0 for r in out)
    assert mix_sources(none).count() == 0 and mixed(none).count() == 0
    assert mixed(odd).columns == odd.columns
    got = Counter((r.doc_id, r.text) for r in mixed(odd).collect())
    assert {i for i, _ in got} <= {r.doc_id for r in out} | {3} and got[3, "The quick brown fox jumps over the lazy dog near the river bank today\nand then it sleeps under the tall oak tree"] % 2 == 0


def test_ties_and_null_ids(spark):
    """Rows without ids share a key and tie; equal rows keep together."""
    rows = [(None, f"{'a ' * (k % 3 + 1)}", "s") for k in range(30)] + [(1, "b b", "s")] * 4 + [(2, None, "s"), (3, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(docs, max_epochs=100).collect()
    per = Counter((r.doc_id, r.epoch) for r in out)
    assert all(n in (4, 0) or r[1] == max(e for i, e in per if i == 1) for r, n in per.items() if r[0] == 1)
    copies = Counter(r.doc_id for r in mixed(docs, max_epochs=100).collect())
    assert copies[1] % 4 == 0 and set(copies) <= {None, 1, 2, 3} and {r.source for r in out} <= {"", "s"}
