import random

import pytest

from sluicework.llm import line_dedup as line_dedup_module
from sluicework.llm.line_dedup import MIN_CHARS, Lines, line_dedup, without_repeats


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < MIN_CHARS:
        return False
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """Texts after dedup by position, with the number of dropped lines."""
    places = [(i, no, line.strip(" \t\r")) for i, text in rows if i is not None and text is not None for no, line in enumerate(text.split("\n"))]
    out = []
    for i, text in rows:
        if i is None or text is None:
            out.append((text, 0))
            continue
        kept, gone = [], 0
        for no, line in enumerate(text.split("\n")):
            own = line.strip(" \t\r")
            if own and any((j, k) < (i, no) and near(own, x) for j, k, x in places):
                gone += 1
            else:
                kept.append(line)
        out.append(("\n".join(kept), gone))
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(zip(map(str, (i for i, _ in rows)), brute(rows)), key=str)
    got = sorted(((str(r.doc_id), (r.text, r.n_dropped)) for r in line_dedup(df).collect()), key=str)
    assert got == want
    return want


def test_random_edits(spark):
    rng = random.Random(5)
    rows, lines = [], ["the line number zero of them all"]
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(lines) if rng.random() < 0.7 else "".join(rng.choice("abcdé ñ") for _ in range(rng.randint(10, 40)))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(line))
                line = rng.choice((line[:k] + "z" + line[k:], line[:k] + line[k + 1 :], line[:k] + "é" + line[k + 1 :]))
            lines.append(line)
            text.append(line)
        rows.append((rng.randint(0, 1000) * 100 + i, "\n".join(text)))
    want = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sum(n for _, (_, n) in want) > 20


def test_odd_rows(odd, none):
    check(odd)
    assert line_dedup(none).count() == 0
    kept = without_repeats(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and None in ids and 4 in ids and 5 in ids


def test_short_lines_go_when_equal(spark):
    rows = [(1, "ok\n\n yes\nthe line number zero of them all"), (2, "yes\nyez\n\nok \nthe line number zero of them al"), (3, "ok"), (4, "yes\n19 characters long!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs).collect()}
    assert got == {1: (rows[0][1], 4, 0), 2: ("yez\n", 5, 3), 3: ("", 1, 1), 4: ("19 characters long!", 2, 1)}


def test_subscribe_lines(spark):
    docs = spark.createDataFrame([(i, "Subscribe now!\nshare this") for i in range(5)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup(docs).collect()) == [(0, 0), (1, 2), (2, 2), (3, 2), (4, 2)]


def test_filter_keys_miss_no_neighbour():
    """Two lines within one edit share a key whose parities are at most two bits apart."""
    rng = random.Random(9)
    for _ in range(400):
        a = "".join(rng.choice("abcdé 日") for _ in range(rng.randint(20, 45))).strip().ljust(20, "x")
        k = rng.randrange(1, len(a) - 1)
        b = rng.choice((a[:k] + "z" + a[k:], a[:k] + "ñ" + a[k + 1 :], a[:k] + a[k + 1 :]))
        keys = []
        for line in (a, b):
            found = list(Lines(f"\n  {line}\t\nother", 5).keys())
            keys.append([(int(key[0]), int(parity[0])) for key, parity in found])
        assert any(x == y and bin(p ^ q).count("1") <= 2 for x, p in keys[0] for y, q in keys[1])


@pytest.mark.parametrize("block", [1, 3])
def test_frequent_keys_are_split_without_loss(spark, monkeypatch, block):
    """Many lines that differ in one block only, some of them by one character."""
    monkeypatch.setattr(line_dedup_module, "KEY_BLOCK", block)
    rng = random.Random(4)
    lines = [f"the user with the number {rng.randrange(10**6):06d} has logged in again today" for _ in range(60)]
    lines += [x.replace("6", "7", 1) for x in lines[:30]] + [x + "!" for x in lines[20:40]]
    rng.shuffle(lines)
    want = check(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(4))
    assert sum(n for _, (_, n) in want) > 20


def test_clashing_columns(odd, spark):
    """Columns with the names that are added, or are used inside, are replaced or stay."""
    docs = odd.selectExpr("doc_id", "text", "'a' n_lines", "'b' h", "'c' first", "'d' no", "'e' __gone2", "size line")
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "h", "first", "no", "__gone2", "line", "n_lines", "n_dropped"]
    assert without_repeats(docs).columns == docs.columns and without_repeats(docs.limit(0)).count() == 0
