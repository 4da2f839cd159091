"""Kernels on known answers, random graphs, and every query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sluicework.functions import comments as C
from sluicework.functions import identity as I
from sluicework.functions import paths as P
from sluicework.functions import scores as S
from sluicework.operators import clones, diff, graph, health, lines, report
from sluicework.plans import catalogue
from sluicework.sources import baseline, config

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def tarjan_free(edges):
    """Components of two or more nodes, by reachability."""
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] = reach[n] | reach[k]
    groups = {frozenset([n, *(m for m in nodes if m in reach[n] and n in reach[m])]) for n in nodes}
    return {tuple(sorted(g)) for g in groups if len(g) > 1}


@pytest.mark.parametrize("seed,small", [(1, 0), (2, 0), (1, 10**6), (2, 10**6), (3, 12)])
def test_components_on_random_graphs(spark, monkeypatch, seed, small):
    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    rng = random.Random(seed)
    edges = [(rng.randrange(24), rng.randrange(24)) for _ in range(34)] + [(50, 51), (51, 50), (60, 60)]
    got = {tuple(r.members) for r in graph.cycles(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == tarjan_free([e for e in edges if e[0] != e[1]])
    names = [(f"n{a}", f"n{b}") for a, b in edges]
    got = {tuple(r.members) for r in graph.cycles(spark.createDataFrame(names, "src string, dst string")).collect()}
    assert got == tarjan_free([e for e in names if e[0] != e[1]])


def test_a_long_cycle_needs_no_recursion(spark):
    edges = spark.range(5000).selectExpr("id src", "(id + 1) % 5000 dst")
    r = graph.cycles(edges).first()
    assert r.root == 0 and r.n == 5000


def test_closure(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("d", "d")]
    got = {tuple(r) for r in graph.closure(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("x", "c"), ("x", "d")}


@pytest.mark.parametrize("rows,score,grade", [([(2, 1)] * 9 + [(50, 3)], 90, "A"), ([(30, 5)] * 5, 50, "D"), ([(1000, 0)], 0, "F"), ([], 100, "A"), ([(10, 10)] * 3, 100, "A")])
def test_health(spark, rows, score, grade):
    r = health.health(spark.createDataFrame(rows, "cyclomatic int, cognitive int")).first()
    assert (r.score, r.grade) == (score, grade)


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert [val(S.grade(F.lit(n))) for n in (90, 89, 75, 74, 60, 59, 45, 44)] == list("ABBCCDDF")
    hot = [val(S.hotspot(F.lit(a), F.lit(b))) for a, b in ((20, 19), (21, 20), (2, 31), (22, 1), (1, 0))]
    assert hot == [False, True, True, False, False]
    assert val(I.fingerprint(F.lit("r"), F.lit("a\\b"), F.lit("x"))) == I.fingerprint_of("r", "a/b", "x")
    assert val(I.fingerprint(F.lit("r"), F.lit("a/b"), F.lit("x"))) != val(I.fingerprint(F.lit("ra"), F.lit("/b"), F.lit("x")))
    assert val(C.normal_comment(F.lit("//  The Foo Method. "))) == "the foo method"
    assert val(C.lint_names(F.lit(" b ,a_x - because"))) == "a_x,b" and val(C.reason(F.lit(" b ,a_x - because"))) == "because"
    ok, bare = C.DIRECTIVE + " rule-x - known", C.DIRECTIVE + " rule-x"
    assert [val(C.directive_rule(F.lit(x))) for x in (ok, bare, " " + ok)] == ["rule-x", None, None]
    assert val(S.pad(F.lit("abcdef"), 3)) == "abcdef" and val(S.pad(F.lit("a"), 3, left=True)) == "  a"
    made = [val(P.generated(F.lit(p))) for p in ("lib/a.g.dart", "lib/a.dart", "lib/l10n/app_localizations_de.dart", "lib/x.freezed.dart")]
    assert made == [True, False, True, True]


@pytest.mark.parametrize("glob,yes,no", [("lib/*.dart", ["lib/a.dart"], ["lib/b/a.dart"]), ("**/a.dart", ["a.dart", "x/y/a.dart"], ["xa.dart"]), ("lib/**", ["lib/a/b"], ["lib2/a"]), ("{a,b}/?.x", ["a/1.x", "b/2.x"], ["c/1.x", "a/12.x"])])
def test_globs(spark, glob, yes, no):
    got = {r.p for r in spark.createDataFrame([(p,) for p in yes + no], "p string").where(P.matches_any(F.col("p"), [glob])).collect()}
    assert got == set(yes)


def test_diff_and_gates(spark):
    cur = spark.createDataFrame([("a", 9), ("a", 10), ("b", 1)], "fingerprint string, line int")
    base = spark.createDataFrame([("a", 1), ("c", 2)], "fingerprint string, line int")
    d = diff.baseline_diff(cur, base)
    assert sorted((r.fingerprint, r.line, r.status) for r in d.collect()) == [("a", 9, "kept"), ("a", 10, "kept"), ("b", 1, "new"), ("c", 2, "fixed")]
    assert diff.ratchet(d).first().asDict() == {"new_count": 1, "kept_count": 2, "fixed_count": 1, "passed": False}
    assert [diff.absolute(cur.limit(n), 2).first().passed for n in (2, 3)] == [True, False]


def test_renamed_clones(spark):
    body = lambda names: [("other" if x in "=+;" else "id") + "\x01" + names.get(x, x) for x in "a = b + c ; a = c + b ;".split()]
    rows = [(k, body(names)) for k, names in enumerate(({}, {"a": "x", "b": "y", "c": "z"}, {"b": "a"}))] + [(9, []), (10, None), (11, ["id\x01a"])]
    found = clones.renamed_clusters(spark.createDataFrame(rows, "block int, items array<string>"), ["block"], min_tokens=5, min_distinct=3).collect()
    assert [[b.block for b in r.blocks] for r in found] == [[0, 1]]
    assert clones.renamed_clusters(spark.createDataFrame([], "block int, items array<string>"), ["block"]).count() == 0


def test_lines_and_layers(spark):
    rows = lines.lines(spark.createDataFrame([(1, "// a\nb\n\nc")], "k int, t string"), ["k"], "t")
    got = lines.with_previous(rows, ["k"], "line_no", C.is_comment(F.col("line"))).orderBy("line_no").collect()
    assert [(r.line_no, r.line, r.previous) for r in got] == [(1, "// a", False), (2, "b", True), (3, "", False), (4, "c", False)]
    cat = report.catalogue(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "rule string, n int"), "rule", ["n"]).collect()
    assert [(r.rule, r.rule_index) for r in cat] == [("b", 0), ("a", 1)]


def test_config_and_baseline(spark, tmp_path):
    c = config.merge([config.parse("rules:\n  a: false\nignore: [x, y]\n"), config.parse("rules:\n  a: true\n  b: false\nignore:\n  - y\n  - z\na11y: false\n")])
    assert (c.rules, c.ignore, c.source_dirs, c.a11y) == ({"a": True, "b": False}, ["x", "y", "z"], ["lib", "bin"], False)
    for bad in ("rules: 3", "a11y: maybe", "- x\n"):
        with pytest.raises(config.ConfigError):
            config.merge([config.parse(bad)])
    path = str(tmp_path / "b.json")
    rows = spark.createDataFrame([("f2", "r", "b", 2, "m"), ("f1", "r", "a", 1, "m|é")], baseline.SCHEMA)
    assert baseline.write(path, rows, "v") == 2
    back, version = baseline.read(spark, path)
    assert version == "v" and [r.fingerprint for r in back.collect()] == ["f1", "f2"]
    for text in ("{", "{}", '{"schemaVersion": 9, "rulesetVersion": "", "findings": []}'):
        (tmp_path / "b.json").write_text(text)
        with pytest.raises(baseline.BaselineError):
            baseline.read(spark, path)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, sf_dir).collect()]
    cols = catalogue.QUERIES[name](spark, sf_dir).columns
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["digest", "token_count", "n", "blocks"]


def test_order_graph_takes_all_orders(spark):
    rng = random.Random(7)
    customers = [(k, k % 3) for k in range(1, 91)]
    orders = [(k, rng.randint(1, 90), rng.choice("FOP"), rng.choice("ab"), rng.randint(1, 30)) for k in range(70)]
    tables = {"customer": spark.createDataFrame(customers, "c_custkey long, c_nationkey int"), "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate int")}
    groups = {}
    for key, cust, _, prio, date in orders:
        groups.setdefault((prio, cust % 3), []).append((date, key, cust))
    edges = {(a[2], b[2]) for g in groups.values() for a, b in zip(sorted(g), sorted(g)[1:]) if a[2] != b[2]}
    assert {tuple(r) for r in catalogue.order_edges(tables.__getitem__).collect()} == edges
    got = {r.members for r in catalogue.q_cycles(tables.__getitem__).collect()}
    assert got == {",".join(map(str, g)) for g in tarjan_free(edges)} and got
