"""Queries that write Dart sources out of whole tables and run the front end, the rules and the runner on them.

Their SQL knows what each source must give, from the same columns. A row is one or two files; the text depends on the row.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ..sources import config, project
from . import rules as R
from . import runner
from .registry import query

KEY = "p_partkey"
FOUND = ("file_path", "line", "kind", "fingerprint")


def text(template: str, **parts: Column) -> Column:
    """template with {name} replaced by columns; {k} is the row's key unless given. Double braces are braces."""
    parts = {"k": F.col(KEY).cast("string")} | parts
    out = []
    for before, name, _, _ in Formatter().parse(template):
        out += [F.lit(before)] if before else []
        out += [parts[name]] if name else []
    return F.concat(*out)


def size(n: int) -> Column:
    return F.col("p_size") % n


def case(n: int, *texts: str) -> Column:
    """The text for a row's size % n."""
    out = F.lit(texts[-1])
    for i, x in enumerate(texts[:-1]):
        out = F.when(size(n) == i, x).otherwise(out)
    return out


def files(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    return rows.select(path.alias("path"), content.alias("content"))


def parts_project(t, template: str, path: Column | None = None, kinds: tuple[str, ...] | None = None, **parts: Column) -> project.Project:
    """The project of one file a part, with facts of some kinds. The table is spread over tasks before it becomes texts."""
    path = text("lib/p{k}.dart") if path is None else path
    return project.from_files(files(part_rows(t), path, text(template, **parts)), project.Profile("demo"), kinds=kinds, even=True)


def part_rows(t) -> DataFrame:
    return spread(t("part").select(KEY, "p_size"), KEY)


def _print(rule: str, anchor: str, path: str = "'lib/p' || p_partkey || '.dart'") -> str:
    return f"substr(sha256('{rule}' || chr(0) || {path} || chr(0) || {anchor}), 1, 16) AS fingerprint"


def _row(line: int, kind: str, rule: str, anchor: str, where: str, path: str = "'lib/p' || p_partkey || '.dart'") -> str:
    return f"SELECT {path} AS file_path, {line} AS line, '{kind}' AS kind, {_print(rule, anchor, path)} FROM part WHERE {where}"


def _sql(*rows: str) -> str:
    return "\nUNION ALL ".join(rows)


_CATCH = "slop-empty-catch"


@query(
    _sql(
        _row(3, "empty-catch", _CATCH, "'C' || p_partkey || '.run:catch:0'", "p_size % 3 < 2"),
        _row(4, "empty-catch", _CATCH, "'C' || p_partkey || '.run:catch:' || CASE WHEN p_size % 3 < 2 THEN 1 ELSE 0 END", "TRUE"),
    )
)
def q_dart_empty_catch(t):
    source = "class C{k} {{\n  void run() {{\n    try {{ go(); }} catch (e) {{{body} }}\n    try {{ go(); }} on Error catch (e) {{ /* why */ }}\n  }}\n}}\n"
    return R.slop_empty_catch(parts_project(t, source, kinds=("catch",), body=case(3, "", " /* x */ ", " log(e); ")), ()).select(*FOUND)


_TOLD = "slop-narrative-comment"


@query(
    _sql(
        _row(1, "narrative-comment", _TOLD, "'Big' || p_partkey || ':narrative-comment:0'", "p_size % 4 <> 2"),
        _row(3, "narrative-comment", _TOLD, "'Big' || p_partkey || '.go' || p_partkey || ':narrative-comment:0'", "p_size % 2 = 0"),
    )
)
def q_dart_comments(t):
    told = F.when(size(4) == 0, text("Big{k}")).when(size(4) == 1, text("The big{k} widget.")).otherwise(case(4, "", "", "Holds what matters", "Constructor"))
    inner = F.when(size(2) == 0, text("go{k}!")).otherwise("Runs it")
    source = "// {told}\nclass Big{k} {{\n  // {inner}\n  void go{k}() {{}}\n}}\n// Colour\nenum Colour {{ red }}\n"
    return R.slop_narrative_comment(parts_project(t, source, kinds=("comment", "decl"), told=told, inner=inner), ()).select(*FOUND)


_IGNORE = "slop-unjustified-ignore"


@query(
    _sql(
        _row(2, "unjustified-ignore", _IGNORE, "'ignore:a_x,b_' || p_partkey || ':0'", "p_size % 2 = 1").replace(" AS line,", " AS line, 3 AS col,"),
        _row(4, "unjustified-ignore", _IGNORE, "'ignore_for_file:dead_code:0'", "p_size % 3 <> 0").replace(" AS line,", " AS line, 12 AS col,"),
    )
)
def q_dart_ignores(t):
    source = "{above}\n  // ignore: b_{k} , a_x\nint z = 3;\nint x = 1; // ignore_for_file: dead_code{why}\n"
    rows = R.slop_unjustified_ignore(parts_project(t, source, kinds=(), above=case(2, "// why", "int y = 2;"), why=case(3, " - known", "", "")), ())
    return rows.select("file_path", "line", F.col("column").alias("col"), "kind", "fingerprint")


@query(
    _sql(
        _row(4, "missing-semantic-label", "a11y-image-label", "'make' || p_partkey || ':asset'", "p_size % 2 = 0"),
        _row(5, "missing-accessible-name", "a11y-icon-button-label", "'make' || p_partkey || ':IconButton:0'", "p_size % 3 <> 0"),
        _row(8, "missing-accessible-name", "a11y-icon-button-label", "'make' || p_partkey || ':InkWell:0'", "TRUE"),
        _row(6, "missing-form-label", "a11y-form-field-label", "'make' || p_partkey || ':TextField:0'", "p_size % 3 <> 1"),
        _row(9, "missing-accessible-name", "a11y-interactive-semantics", "'make' || p_partkey || ':Tap' || p_partkey || ':0'", "p_size % 4 <> 1"),
        _row(10, "missing-accessible-name", "a11y-interactive-semantics", "'make' || p_partkey || ':FancyCard:0'", "p_size % 2 = 1"),
    )
)
def q_dart_widgets(t):
    source = (
        "import 'package:flutter/material.dart';\n{extra}make{k}() {{\n  return [Image.asset('a'{a}),\n  IconButton(icon: Icon(1){b}),\n  TextField({c}),\n"
        "  Semantics(label: 'x', child: Row(IconButton(icon: Icon(2)))),\n  InkWell(onTap: f, child: Icon(3)),\n  Tap{k}(onTap: f{d}),\n  FancyCard(onTap: f),\n  ListTile(onTap: f)];\n}}\nclass Tap{k} {{}}\n"
    )
    args = {
        "a": case(2, "", ", semanticLabel: 'l'"),
        "b": case(3, ", tooltip: 't'", "", ""),
        "c": case(3, "", "decoration: InputDecoration(labelText: 'n')", "decoration: const InputDecoration(hintStyle: h)"),
        "d": case(4, "", ", label: 'z'", ", label: ''", ", tooltip: null"),
        "extra": case(2, "import 'dart:ui';\n", "import 'package:fancy/fancy.dart';\n"),
    }
    p = parts_project(t, source, kinds=("decl", "node", "uri"), **args)
    rules = (R.a11y_image_label, R.a11y_icon_button_label, R.a11y_form_field_label, R.a11y_interactive_semantics)
    out = rules[0](p, ())
    for rule in rules[1:]:
        out = out.unionByName(rule(p, ()))
    return out.select(*FOUND)


_METRICS = "SELECT p_partkey, 7 + 2 * (p_size % 7) + 2 * (p_size % 5) AS cyclomatic, 6 + 2 * (p_size % 7) + 4 * (p_size % 5) AS cognitive FROM part"


def _decisions(t) -> project.Project:
    source = (
        "int f{k}(a, b) {{\n{ifs}{loops}  switch (a) {{ case 1: go(); break; case int n when n > 1 || b: no(); break; default: go(); }}\n"
        "  final c = switch (a) {{ 1 || 2 => 3, int n when (n > 9) => 4, _ => 5 }};\n  return a ? b ?? 1 : 2;\n}}\n"
    )
    many = lambda x, n: F.repeat(F.lit(x), (size(n)).cast("int"))
    return parts_project(t, source, kinds=("point", "unit"), ifs=many("  if (a == 1 && b) { go(); }\n", 7), loops=many("  for (var i in a) { if (i) { go(); } else { no(); } }\n", 5))


@query(f"SELECT 'lib/p' || p_partkey || '.dart' AS file_path, 1 AS line, 'f' || p_partkey AS qualified_name, cyclomatic + 1 AS cyclomatic, cognitive AS cognitive FROM ({_METRICS})")
def q_dart_complexity(t):
    return R.complexity(_decisions(t), ("lib",)).select("file_path", "line", "qualified_name", "cyclomatic", "cognitive")


@query(
    f"""SELECT 'lib/p' || p_partkey || '.dart' AS file_path, 'f' || p_partkey || ' is hard to follow: ' || concat_ws(', ', CASE WHEN cyclomatic > 20 THEN 'cyclomatic ' || cyclomatic || ' > 20' END,
  CASE WHEN cognitive > 30 THEN 'cognitive ' || cognitive || ' > 30' END) AS message, {_print('complexity-hotspots', "'f' || p_partkey")}
FROM (SELECT p_partkey, cyclomatic + 1 AS cyclomatic, cognitive FROM ({_METRICS})) WHERE cognitive > 30 OR (cyclomatic > 20 AND cognitive > 5)"""
)
def q_dart_hotspots(t):
    return R.complexity_hotspots(_decisions(t), ("lib",)).select("file_path", "message", "fingerprint")


_SRC = "'lib/src/p' || p_partkey || '.dart'"
_GONE = "unused-public-exports"


@query(
    _sql(
        _row(1, "unused-public-export", _GONE, "'A' || p_partkey", "p_size % 2 <> 0", _SRC),
        _row(2, "unused-public-export", _GONE, "'A' || p_partkey || '.m' || p_partkey", "p_size % 3 <> 0", _SRC),
        _row(3, "unused-public-export", _GONE, "'A' || p_partkey || '.g' || p_partkey", "TRUE", _SRC),
        _row(5, "unused-public-export", _GONE, "'u' || p_partkey", "p_size % 5 <> 0", _SRC),
        _row(10, "unused-public-export", _GONE, "'E' || p_partkey", "p_size % 7 <> 0", _SRC),
        _row(10, "unused-public-export", _GONE, "'E' || p_partkey || '.x' || p_partkey", "p_size % 7 <> 0", _SRC),
    )
)
def q_dart_unused(t):
    source = (
        "class A{k} {{\n  void m{k}() {{}}\n  int get g{k} => 1;\n}}\nvoid u{k}() {{}}\n@visibleForTesting\nvoid v{k}() {{}}\nvoid _w{k}() {{}}\n@freezed class D{k} {{}}\n"
        "extension E{k} on int {{ void x{k}() {{}} }}\n"
    )
    use = lambda n, x: F.when(size(n) == 0, text(x)).otherwise("")
    test = text("void main() {{ {a}{b}{c}{d} }}\n", a=use(2, "A{k}(); "), b=use(3, "it.m{k}(); "), c=use(5, "u{k}(); "), d=use(7, "1.x{k}(); "))
    rows = part_rows(t)
    own = files(rows, text("lib/src/p{k}.dart"), text(source)).unionByName(files(rows, text("test/p{k}_test.dart"), test))
    return R.unused_public_exports(project.from_files(own, project.Profile("demo"), kinds=("decl", "ref", "supertype", "uri"), even=True), ()).select(*FOUND)


@query(
    """SELECT min(path) AS file_path, 1 AS line, tokens AS token_count, count(*) AS n,
  substr(sha256('code-duplicates' || chr(0) || min(path) || chr(0) || 'tokens=' || tokens || chr(10) || string_agg(path || ':1', chr(10) ORDER BY path || ':1')), 1, 16) AS fingerprint
FROM (SELECT 'lib/c' || c_custkey || '.dart' AS path, 11 * (5 + c_nationkey % 5) AS tokens FROM customer) GROUP BY tokens HAVING count(*) >= 2"""
)
def q_dart_duplicates(t):
    k = F.col("c_custkey").cast("string")
    statement = text(" x{k} = add{k}(x{k}, 1) + y{k};", k=k)
    source = text("void f{k}() {{{body} }}\n", k=k, body=F.repeat(statement, (5 + F.col("c_nationkey") % 5).cast("int")))
    rows = spread(t("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    p = project.from_files(files(rows, text("lib/c{k}.dart", k=k), source), project.Profile("demo"), kinds=("body",), even=True)
    found = F.regexp_extract("message", r"^(\d+) bodies of (\d+) tokens", 1), F.regexp_extract("message", r"^(\d+) bodies of (\d+) tokens", 2)
    return R.code_duplicates(p, ("lib",)).select("file_path", "line", found[1].cast("int").alias("token_count"), found[0].cast("long").alias("n"), "fingerprint")


@query(
    """WITH m AS (SELECT n_regionkey AS r, 'lib/n' || n_nationkey || '.dart' AS path FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_regionkey, 'lib/r' || r_regionkey || '.dart' FROM region)
SELECT min(path) AS file_path, CASE WHEN count(*) = 2 THEN 'bidirectional-cycle' ELSE 'multi-file-cycle' END AS kind,
  substr(sha256('circular-dependencies' || chr(0) || min(path) || chr(0) || string_agg(path, chr(10) ORDER BY path)), 1, 16) AS fingerprint FROM m GROUP BY r HAVING count(*) >= 2"""
)
def q_dart_cycles(t):
    """Regions import their nations, even nations their region, suppliers their nation; what is exported makes no edge."""
    n, r, s = (F.col(c).cast("string") for c in ("n_nationkey", "n_regionkey", "s_suppkey"))
    up = F.when(F.col("n_nationkey") % 2 == 0, text("import 'r{r}.dart';\n", r=r, k=n)).otherwise(text("export 'r{r}.dart';\n", r=r, k=n))
    nation = files(t("nation"), text("lib/n{k}.dart", k=n), up)
    lines = F.array_join(F.sort_array(F.collect_list(text("import 'package:demo/n{k}.dart';", k=n))), "\n")
    down = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey").agg(lines.alias("lines"))
    region = down.select(text("lib/r{k}.dart", k=F.col("r_regionkey").cast("string")).alias("path"), F.coalesce("lines", F.lit("")).alias("content"))
    supplier = files(t("supplier"), text("lib/s{k}.dart", k=s), text("import 'n{n}.dart';\n", k=s, n=F.col("s_nationkey").cast("string")))
    return R.circular_dependencies(project.from_files(nation.union(region).union(supplier), project.Profile("demo")), ()).select("file_path", "kind", "fingerprint")


@query(
    _sql(
        _row(3, "empty-catch", _CATCH, "'f' || p_partkey || ':catch:0'", "p_size % 2 = 1 AND p_size % 5 <> 0"),
        _row(4, "empty-catch", _CATCH, "'f' || p_partkey || ':catch:1'", "p_size % 5 <> 0"),
        _row(6, "narrative-comment", _TOLD, "'G' || p_partkey || ':narrative-comment:0'", "p_size % 5 <> 0"),
    )
)
def q_dart_scan(t):
    """A run of all slop rules with suppressions in the sources and by a glob, in the total order."""
    p = _suppressed(t)
    return runner.ordered(runner.analyse(p, config.Config(ignore=["tool/**"]), "slop").findings).select(*FOUND)


def _suppressed(t) -> project.Project:
    path = F.when(size(5) == 0, text("tool/gen/p{k}.dart")).otherwise(text("lib/p{k}.dart"))
    known = case(2, "// sluice-ignore: slop-empty-catch - known", "// sluice-ignore: slop-empty-catch")
    source = "void f{k}() {{\n  {known}\n  try {{ go(); }} catch (e) {{}}\n  try {{ go(); }} catch (e) {{}}\n}}\n// G{k}\nclass G{k} {{}}\n"
    return parts_project(t, source, path, ("catch", "comment", "decl"), known=known)


@query("SELECT count(*) * 3 AS raw, count(*) FILTER (p_size % 5 = 0) * 3 + count(*) FILTER (p_size % 5 <> 0 AND p_size % 2 = 0) AS suppressed FROM part")
def q_dart_suppressed(t):
    out = runner.analyse(_suppressed(t), config.Config(ignore=["tool/**"]), "slop")
    return out.findings.agg((F.count("*") + out.suppressed).alias("raw"), F.lit(out.suppressed).cast("long").alias("suppressed"))


def _broken(t) -> project.Project:
    path = F.when(size(3) == 0, text("bin/p{k}.dart")).otherwise(text("lib/p{k}.dart"))
    return parts_project(t, "{part}void f{k}() {{\n}}\n{bad}", path, (), part=F.when(size(6) == 0, "part of 'x.dart';\n").otherwise(""), bad=F.when(size(4) == 0, "void broken( {\n").otherwise(""))


@query("SELECT CASE WHEN p_size % 3 = 0 THEN 'bin/p' ELSE 'lib/p' END || p_partkey || '.dart' AS path FROM part WHERE p_size % 4 = 0 AND p_size % 6 <> 0")
def q_dart_errors(t):
    return _broken(t).errors().select("path")


@query(
    """SELECT count(*) AS files, count(*) FILTER (p_size % 3 <> 0) AS lib_files, CAST(sum(CASE WHEN p_size % 6 = 0 THEN 4 ELSE 3 END) AS BIGINT) AS lines FROM part WHERE p_size % 4 <> 0"""
)
def q_dart_stats(t):
    return runner.stats(_broken(t))


@query(
    """SELECT 'lib/p' || p_partkey || '.dart' AS path, name, reason FROM (
  SELECT p_partkey, 'G' || p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN 'base type Table' WHEN p_size % 5 = 0 THEN 'annotation freezed' WHEN p_size % 3 = 2 AND p_size % 2 = 0 THEN 'generated part' END AS reason FROM part
  UNION ALL SELECT p_partkey, 'H' || p_partkey, CASE WHEN p_size % 3 = 0 THEN 'base type Table' WHEN p_size % 3 = 2 AND p_size % 2 = 0 THEN 'generated part' END FROM part) WHERE reason IS NOT NULL"""
)
def q_dart_codegen(t):
    above = F.when(size(3) == 0, "Table").when(size(3) == 1, "Notifier").otherwise(text("_$G{k}"))
    part = case(2, "part 'p.g.dart';\n", "")
    source = "{part}{note}class G{k} extends {above} {{}}\nclass H{k} extends G{k} {{}}\n"
    return R.codegen_inputs(parts_project(t, source, kinds=("decl", "supertype", "uri"), part=part, above=above, note=F.when(size(5) == 0, "@freezed\n").otherwise("")))
