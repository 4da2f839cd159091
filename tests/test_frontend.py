"""The parser's facts, the sources and the rules on small projects, each with what must come out."""

import pytest

from sluicework.frontend.parser import parse
from sluicework.plans import rules as R
from sluicework.plans import runner
from sluicework.sources import baseline, config, project, yaml


def points(body: str) -> tuple[int, int]:
    """(cyclomatic, cognitive) of a function with this body."""
    found = [f["props"] for f in parse("lib/a.dart", f"f(a, b) {{ {body} }}") if f["fact"] == "point"]
    cost = lambda p: 0 if p["cog"] == "0" else 1 + int(p["depth"]) if p["nested"] == "true" else 1
    return 1 + sum(int(p["cyc"]) for p in found), sum(map(cost, found))


@pytest.mark.parametrize(
    "body,want",
    [
        ("", (1, 0)),
        ("if (a) {}", (2, 1)),
        ("if (a) {} else if (b) {} else {}", (3, 3)),
        ("if (a) { if (b) {} }", (3, 3)),
        ("for (var i in a) { while (b) { do {} while (a); } }", (4, 6)),
        ("if (a && b && a) {}", (4, 2)),
        ("if (a && b || a && b) {}", (5, 4)),
        ("try { f(); } on E catch (e) { if (a) {} } finally {}", (3, 3)),
        ("return a ?? (b ? 1 : 2);", (3, 2)),
        ("switch (a) { case 1: break; case 2: break; default: f(); }", (3, 1)),
        ("switch (a) { case int n when n > 1: break; }", (3, 2)),
        ("switch (a) { case 1 || 2: break; }", (2, 1)),
        ("if (a case int n when n > 1 && b) {}", (4, 3)),
        ("if (a case (1 || 2) && int _) {}", (2, 1)),
        ("final x = switch (a) { 1 || 2 => 3, int n when (n > 1) => 4, int n when n > 5 || b => 6, _ => 5 };", (4, 3)),
        ("f(() { if (a) {} });", (2, 1)),
        ("if (a) { f(() { if (b) {} }); }", (3, 2)),
        ("void g() { if (a) {} } if (b) { g(); }", (3, 2)),
        ("final when = 1; print(when);", (1, 0)),
    ],
)
def test_decision_points(body, want):
    assert points(body) == want


def test_patterns_make_no_calls():
    facts = parse("lib/a.dart", "f(a) { switch (a) { case Image(width: 1): g(Icon(2)); } }")
    assert [f["name"] for f in facts if f["fact"] == "node"] == ["Icon"]


def code(spark, files: dict[str, str], manifest: str = "name: demo\n") -> project.Project:
    return project.from_files(spark.createDataFrame(list(files.items()), "path string, content string"), project.profile_of(manifest))


def lines(rows):
    return sorted((r.file_path, r.line) for r in rows.collect())


def unused(spark, text: str, **more: str):
    rows = R.unused_public_exports(code(spark, {"lib/src/a.dart": text, **{k.replace("__", "/") + ".dart": v for k, v in more.items()}}), ())
    return sorted(r.message.rsplit(" ", 1)[1] for r in rows.collect())


def test_code_generation_inputs(spark):
    text = "class Base extends Table {}\nclass Deep extends Base {}\nclass V extends View {}\nclass N extends Notifier {}\n@GenerateMocks([int])\nclass M {}\n@Entity()\nclass E {}\n@DataClassName('x')\nclass C {}\n@RestApi()\nclass P {}\n"
    assert unused(spark, text) == ["N", "P"]
    made = "part 'a.g.dart';\nclass X extends _$X {}\nclass Plain {}\n"
    assert unused(spark, made) == ["Plain"] and unused(spark, made.replace("a.g.dart", "b.dart")) == ["Plain", "X"]


def test_publishable_packages_keep_their_api(spark):
    files = {"lib/api.dart": "class Api {}\n", "lib/src/in.dart": "class In {}\n"}
    assert lines(R.unused_public_exports(code(spark, files), ())) == [("lib/src/in.dart", 1)]
    assert len(lines(R.unused_public_exports(code(spark, files, "name: demo\npublish_to: none\n"), ()))) == 2


def test_comments_of_types_other_than_classes_are_not_looked_at(spark):
    text = "// Colour\nenum Colour { a }\n// Mix\nmixin Mix {}\n// Ext\nextension Ext on int {}\n// Box\nclass Box {\n  // Box\n  Box();\n  // named\n  Box.named();\n  // size\n  int get size => 1;\n}\n// run\nvoid run() {}\n"
    assert [n for _, n in lines(R.slop_narrative_comment(code(spark, {"lib/a.dart": text}), ()))] == [7, 9, 11, 13, 16]


def test_own_classes_are_not_flutters(spark):
    head = "import 'package:flutter/material.dart';\n"
    use = "f() { return [InkWell(onTap: g, child: Icon(1)),\n TextField(decoration: InputDecoration())]; }\n"
    p = code(spark, {"lib/a.dart": head + use})
    assert len(lines(R.a11y_icon_button_label(p, ()))) == 1 and len(lines(R.a11y_form_field_label(p, ()))) == 1
    p = code(spark, {"lib/a.dart": head + use, "lib/b.dart": "class Icon {}\nclass InputDecoration {}\n"})
    assert not lines(R.a11y_icon_button_label(p, ())) and not lines(R.a11y_form_field_label(p, ()))


def test_widgets_of_other_packages(spark):
    use = "f() { return [Fancy(onTap: g),\n ListTile(onTap: g),\n Fancy(onTap: g, tooltip: 't')]; }\n"
    flutter, other = "import 'package:flutter/material.dart';\n", "import 'package:fancy/fancy.dart';\n"
    assert lines(R.a11y_interactive_semantics(code(spark, {"lib/a.dart": flutter + use}), ())) == []
    assert lines(R.a11y_interactive_semantics(code(spark, {"lib/a.dart": flutter + other + use}), ())) == [("lib/a.dart", 3)]


def test_broken_parts_are_silent(spark):
    p = code(spark, {"lib/a.dart": "void f( {\n", "lib/b.dart": "part of 'a.dart';\nvoid g( {\n", "lib/c.dart": "void h() {}\n"})
    assert [r.path for r in p.errors().collect()] == ["lib/a.dart"] and runner.stats(p).first().files == 1


def test_yaml():
    assert yaml.load("rules: {}\n'a': \"x: y\"\nb: [1, 'c d', {k: v}]\nlist:\n- a\n- b: 1\n  c: 2\nn:\n  deep:\n    x: true # no\nempty:\n") == {"rules": {}, "a": "x: y", "b": [1, "c d", {"k": "v"}], "list": ["a", {"b": 1, "c": 2}], "n": {"deep": {"x": True}}, "empty": None}
    assert yaml.load("# only\n") is None and yaml.load("text: |\n  a\n  b\n") == {"text": "a\nb\n"}
    for bad in ("a: [1, 2", "a: 'x", "a: b: c", "a:\n\t- b", "a: 1\n   b: 2", "k: &x 1", "a: 1\na: 2"):
        with pytest.raises(yaml.YamlError):
            yaml.load(bad)


def test_config_rules():
    known = {"x", "y"}
    read = lambda *texts: config.merge([config.parse(t) for t in texts], known)
    assert read("rules: {}\n'a11y': true\n", "").rules == {}
    assert read("rules: {x: false}\n\"update_check\": false\n").update_check is False
    assert read("source_dirs: [lib/src, ' bin ', lib]\n").source_dirs == ["lib", "bin"]
    assert read("ignore: [a, b]\nrules: {x: true}\n", "ignore: [b, c]\nrules: {x: false, y: true}\n").ignore == ["a", "b", "c"]
    for bad in ("rules: {no-such: false}", "rules: {x: 1}", "source_dirs: ['']", "source_dirs: lib", "ignore: {a: b}", "update_check: 1", "- a", "a: [", "just text"):
        with pytest.raises(config.ConfigError):
            read(bad)


def test_config_discovery(tmp_path):
    inner = tmp_path / "repo" / "pkg"
    inner.mkdir(parents=True)
    (tmp_path / config.NAME).write_text("ignore: [far]\n")
    (inner.parent / config.NAME).write_text("ignore: [mid]\n")
    (inner / config.NAME).write_text("ignore: [near]\n")
    assert config.discover(str(inner)).ignore == ["near"]
    (inner.parent / ".git").mkdir()
    assert config.discover(str(inner)).ignore == ["mid", "near"]


@pytest.mark.parametrize(
    "manifest,want",
    [
        ("", ("", (), False, True)),
        ("name: a\npublish_to: none\n", ("a", (), False, False)),
        ("name: a\nenvironment:\n  flutter: '>=3'\ndependencies:\n  freezed: any\n", ("a", (), False, True)),
        ("dependencies: {flutter: {sdk: flutter}}\ndev_dependencies:\n  source_gen: any\n  mobx_codegen: ^1.0.0\n  mockito: any\n", ("", ("mobx_codegen", "source_gen"), True, True)),
        ("- a\n", ("", (), False, True)),
        ("a: [", ("", (), False, True)),
    ],
)
def test_profiles(manifest, want):
    p = project.profile_of(manifest)
    assert (p.package, p.generators, p.is_flutter, p.is_publishable) == want


def test_baseline_defaults(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text('{"schemaVersion": 1, "rulesetVersion": "v", "findings": [{"fingerprint": "f"}, {"line": 3, "ruleId": null}]}')
    rows, _ = baseline.read(spark, str(path))
    assert sorted(map(tuple, rows.collect())) == [("", "", "", 3, ""), ("f", "", "", 0, "")]
    for bad in ('{"schemaVersion": 1, "rulesetVersion": "v", "findings": [3]}', '{"schemaVersion": 1, "rulesetVersion": "v", "findings": [{"line": "3"}]}', '[]', '{"schemaVersion": 1, "findings": []}'):
        path.write_text(bad)
        with pytest.raises(baseline.BaselineError):
            baseline.read(spark, str(path))
