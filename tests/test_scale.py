"""What must hold at any size: work that is spread, memory that is bounded, and ties that are settled."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluicework.frontend.parser import parse
from sluicework.operators import clones, diff, report
from sluicework.plans import catalogue, generated, rules
from sluicework.session import spread
from sluicework.sources import project


def one_task(spark, n: int):
    return spark.range(n).coalesce(1).withColumnRenamed("id", "k")


def sizes(rows) -> list[int]:
    return [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_one_file_are_spread(spark):
    rows = one_task(spark, 3000)
    assert sizes(rows) == [3000]
    assert len(sizes(spread(rows, "k"))) == 4 and max(sizes(spread(rows, "k", 300))) < 450
    assert spread(rows, "k", 100).distinct().count() == 3000
    few = one_task(spark, 150)
    assert spread(few, "k") is few


def test_files_are_parsed_by_several_tasks(spark):
    k = F.col("k").cast("string")
    files = one_task(spark, 1000).select(F.concat(F.lit("lib/p"), k, F.lit(".dart")).alias("path"), F.concat(F.lit("void f"), k, F.lit("() {}")).alias("content"))
    p = project.from_files(files)
    assert len(p.facts.inputFiles()) >= 4 and p.facts.where("fact = 'decl'").select("name").distinct().count() == 1000


SPREAD = ["complexity", "hotspots", "widgets", "duplicates", "unused", "empty_catch", "scan", "suppressed", "comments", "codegen", "ignores"]


@pytest.mark.parametrize("name", SPREAD)
def test_generated_sources_are_parsed_by_several_tasks(spark, monkeypatch, name):
    made = []
    whole = project.from_files
    monkeypatch.setattr(project, "from_files", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    part = one_task(spark, 1000).select(F.col("k").alias("p_partkey"), (F.col("k") % 50).cast("int").alias("p_size"))
    customer = one_task(spark, 1000).select(F.col("k").alias("c_custkey"), (F.col("k") % 25).cast("int").alias("c_nationkey"))
    assert getattr(generated, f"q_dart_{name}")({"part": part, "customer": customer}.__getitem__).count() > 0
    assert len(made[0].facts.inputFiles()) >= 4


def test_only_the_facts_asked_for(spark):
    text = "// Told\nclass Told extends Up { void go() { if (a) { f(Icon(1)); } try {} catch (e) {} } }\n"
    every = parse("lib/a.dart", text)
    assert {f["fact"] for f in every} >= {"comment", "decl", "supertype", "ref", "unit", "point", "body", "catch", "node", "file"}
    assert parse("lib/a.dart", text, frozenset(("node", "decl"))) == [f for f in every if f["fact"] in ("node", "decl", "file")]
    p = project.from_files(spark.createDataFrame([("lib/a.dart", text)], "path string, content string"), kinds=("decl",))
    assert rules.facts(p, "decl").count() == 2
    with pytest.raises(ValueError):
        rules.facts(p, "node")


def test_a_text_of_all_rows_is_put_together_from_pieces(spark):
    rows = [(f"f{k % 3}", k % 7, f"p{k:02d}", None if k == 5 else f"é{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "path string, line int, print string, t string").repartition(3)
    got = report.joined_text(df, ["path", "line", "print"], F.col("t"), "\n\n")
    assert [r.text for r in got.collect()] == ["\n\n".join(r[3] for r in sorted(rows, key=lambda r: r[:3]) if r[3] is not None)]
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in report.joined_text(df.where("line > 99"), ["path"], F.col("t"), ",").collect()] == [None]
    assert [r.text for r in report.joined_text(df.where("t is null"), ["path"], F.col("t"), ",").collect()] == [""]


def test_the_prompt_collects_no_rows(spark, sf_dir):
    plan = catalogue.QUERIES["q_fix_prompt"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_of_equal_lines_the_last_of_the_table_counts(spark, tmp_path):
    """Rows of one number lie far apart, in tasks of different sizes that are read in another order than the table's."""
    rows = [(k % 50, 1 + k // 50 % 2, 41.0 + (k * 7) % 900) for k in range(900)]
    for n, (a, b) in enumerate(((0, 30), (30, 880), (880, 900))):
        spark.createDataFrame(rows[a:b], "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / f"{n}.parquet"))
    last = {(o, n + 1): q for o, n, q in rows}
    here = {(o, n) for o, n, _ in rows}
    got = catalogue.q_comment_adjacency(lambda _: spark.read.parquet(str(tmp_path / "*.parquet")))
    want = {k: q for k, q in last.items() if k in here}
    assert want and {(r.l_orderkey, r.l_linenumber): r.comment for r in got.collect()} == want


def test_a_diff_keeps_no_keys_in_hash_tables(spark):
    rows = lambda xs: spark.createDataFrame(xs, "fingerprint string, line int")
    cur, base = rows([("a", 1), ("a", 2), ("b", 3), (None, 4)]), rows([("a", 5), ("a", 5), ("c", 6), ("c", 7), (None, 8)])
    found = diff.baseline_diff(cur, base)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.line, r.status) for r in found.collect())
    assert got == [(1, "kept"), (2, "kept"), (3, "new"), (4, "new"), (6, "fixed"), (7, "fixed"), (8, "fixed")]
    assert found.columns == ["fingerprint", "line", "status"]


def test_manifests_are_read_by_several_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(project, "spread", lambda rows, *a: seen.append(spread(rows, *a)) or seen[-1])
    rows = one_task(spark, 1000).select("k", F.concat(F.lit("name: p"), F.col("k").cast("string")).alias("m"))
    got = project.profiles(rows, "k", "m")
    assert len(sizes(seen[0])) >= 4 and {r.package for r in got.collect()} == {f"p{k}" for k in range(1000)}


def test_tokens_are_numbered_in_slices(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * 3, ["b"] * 4, None, ["c"] * 20, ["d"], ["e"] * 7, []])], names=["items"])
    got = [b.column(0).to_pylist() for b in clones.slices(batch, 8)]
    assert [[len(x or []) for x in b] for b in got] == [[3, 4, 0], [20], [1, 7, 0]]
    monkeypatch.setattr(clones, "SLICE", 30)
    run = clones._normal(1, clones.split_kind, ("id",), 1)
    rows = [[f"id\x01{chr(97 + (i + k) % 5)}" for i in range(10)] for k in range(40)]
    whole = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(range(40))], names=["items", "b0"])
    out = list(run(iter([whole])))
    assert len(out) == 14 and max(b.num_rows for b in out) == 3
    assert len({d for b in out for d in b.column("digest").to_pylist()}) == 1 and [k for b in out for k in b.column("b0").to_pylist()] == list(range(40))
