"""Rules on a small project of our own."""

import json
import os

import pytest

from sluicework import cli, reporters
from sluicework.plans import runner
from sluicework.sources import config, project

LONG = "  var total = 0;\n" + "".join(f"  total = total + step{i}(total, {i}) * {'abcdefgh'[i % 8]};\n" for i in range(6)) + "  print(total);\n"
HARD = "void hard(a, b) {\n" + "".join(f"  if (a == {i}) {{\n    while (b) {{ b = a ?? b; }}\n  }}\n" for i in range(12)) + "}\n"
FILES = {
    "pubspec.yaml": "name: demo\npublish_to: none\ndependencies:\n  flutter:\n    sdk: flutter\n",
    "lib/a.dart": "import 'b.dart';\nimport 'package:demo/c.dart';\nvoid useA() { useB(); useC(); }\n",
    "lib/b.dart": "import 'a.dart';\nvoid useB() { useA(); }\n",
    "lib/c.dart": "export 'd.dart';\nvoid useC() {}\nvoid neverCalled() {}\nvoid _private() {}\n@visibleForTesting\nvoid noted() {}\n",
    "lib/d.dart": "void exported() {}\n",
    "lib/clone1.dart": "void one() {\n" + LONG + "}\n",
    "lib/clone2.dart": "\nvoid two() {\n" + LONG.replace("total", "sum").replace("step", "walk") + "}\n",
    "lib/x.g.dart": "void generatedOnly() { try { f(); } catch (e) {} }\n",
    "lib/hard.dart": HARD + "void start() { hard(1, 2); one(); two(); }\n",
    "lib/slop.dart": "void slop() {\n  try {\n    hard(1, 2);\n  } catch (e) {\n    // nothing\n  }\n  // ignore: unused_local, dead_code\n  var x = 1; // ignore: dead_code, it is needed\n"
    "  // why\n  // ignore: other\n  // sluice-ignore: slop-empty-catch - known\n  try { slop(); } catch (e) {}\n}\n// Slop two.\nvoid slopTwo() {}\n// slopTwice\nvoid slopTwice() { slop(); slopTwo(); slopTwice(); }\n",
    "lib/ui.dart": "import 'package:flutter/material.dart';\nclass Tap { Tap({onTap, label}); }\nfinal ui = [\n  Image(image: x),\n  Image.asset('a', semanticLabel: 'b'),\n  IconButton(icon: Icon(1)),\n"
    "  Semantics(label: 'go', child: IconButton(icon: Icon(1))),\n  InkWell(onTap: f, child: Icon(2)),\n  TextField(),\n  TextField(decoration: InputDecoration(labelText: 'x')),\n"
    "  TextField(decoration: const InputDecoration(border: y)),\n  Tap(onTap: f),\n  Tap(onTap: f, label: 'l'),\n  Tap(onTap: f, label: ''),\n];\nvoid show() { ui; }\n",
    "lib/broken.dart": "void broken( {\n",
    "test/a_test.dart": "void main() { show(); start(); useA(); }\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("demo")
    (at / ".git").mkdir()
    for name, text in FILES.items():
        path = at / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(at)


@pytest.fixture(scope="module")
def outcome(spark, root):
    code = project.load(spark, root)
    out = runner.analyse(code)
    return code, out, [r.asDict(recursive=True) for r in runner.ordered(out.findings).collect()]


def of(rows, rule):
    return [(r["file_path"], r["line"]) for r in rows if r["rule_id"] == rule]


def test_drift(outcome):
    _, _, rows = outcome
    assert of(rows, "circular-dependencies") == [("lib/a.dart", 1)]
    assert [r["kind"] for r in rows if r["rule_id"] == "circular-dependencies"] == ["bidirectional-cycle"]
    assert of(rows, "code-duplicates") == [("lib/clone1.dart", 1)]
    assert of(rows, "complexity-hotspots") == [("lib/hard.dart", 1)]
    assert [r["message"].split()[-1] for r in rows if r["rule_id"] == "unused-public-exports"] == ["neverCalled"]


def test_slop(outcome):
    _, out, rows = outcome
    assert of(rows, "slop-empty-catch") == [("lib/slop.dart", 4)]
    assert of(rows, "slop-unjustified-ignore") == [("lib/slop.dart", 7)]
    assert of(rows, "slop-narrative-comment") == [("lib/slop.dart", 16)]
    assert out.suppressed == 1


def test_accessibility(outcome):
    _, _, rows = outcome
    assert of(rows, "a11y-image-label") == [("lib/ui.dart", 4)]
    assert of(rows, "a11y-icon-button-label") == [("lib/ui.dart", 6), ("lib/ui.dart", 8)]
    assert of(rows, "a11y-form-field-label") == [("lib/ui.dart", 9), ("lib/ui.dart", 11)]
    assert of(rows, "a11y-interactive-semantics") == [("lib/ui.dart", 12), ("lib/ui.dart", 14)]


def test_errors_stats_and_contract(outcome):
    code, _, rows = outcome
    assert [r.path for r in code.errors().collect()] == ["lib/broken.dart"]
    s = runner.stats(code).first()
    assert (s.files, s.lib_files) == (11, 10)
    assert all(r["kind"] and r["remedy"] and len(r["fingerprint"]) == 16 for r in rows)


def test_toggles_and_globs(spark, outcome):
    code, _, rows = outcome
    off = config.Config(rules={"a11y-image-label": False}, ignore=["lib/slop*"], a11y=True)
    got = {(r.rule_id, r.file_path) for r in runner.analyse(code, off, "accessibility").findings.collect()}
    assert got and all(r != "a11y-image-label" for r, _ in got)
    got = runner.analyse(code, off, "slop").findings.collect()
    assert got == []
    assert "accessibility" not in {r for r in runner.active(config.Config(a11y=False))}


def test_reports(outcome):
    code, out, rows = outcome
    p = reporters.Payload(out.findings, "/demo", out.version, suppressed=out.suppressed)
    assert "Project: `demo`" in reporters.fix_prompt(p) and reporters.fix_prompt(p).count("Hint: ") == len(rows)
    empty = reporters.Payload(out.findings.limit(0), "/demo", out.version)
    assert "(no findings selected)" in reporters.fix_prompt(empty) and reporters.render("human", empty) == "No findings\n"
    assert "\x1b[33mwarning\x1b[0m" in reporters.render("human", reporters.Payload(out.findings, "/demo", out.version, is_tty=True))
    body = json.loads(reporters.render("json", p))
    assert body["summary"]["total"] == len(rows) == len(body["findings"]) and body["findings"][0]["column"] is None
    log = json.loads(reporters.render("sarif", p))["runs"][0]
    assert {r["level"] for r in log["results"]} == {"warning", "note"}
    assert all(log["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in log["results"])
    assert "lib/ui.dart" in reporters.render("human", p) and "| Line |" in reporters.render("markdown", p)
    assert "<script" in reporters.render("html", p)
    with pytest.raises(ValueError):
        reporters.render("other", p)


def test_cli(spark, root, capsys):
    run = lambda *a: cli.main([*a, "--project-root", root], spark)
    assert run("gate") == 1
    assert run("scan", "--reporter", "json") == 1
    assert run("baseline", "--write") == 0
    assert run("gate") == 0
    with open(os.path.join(root, "lib/slop.dart"), "a") as f:
        f.write("void more() { try { slop(); } catch (e) {} more(); }\n")
    assert run("gate") == 1
    assert run("gate", "--absolute") == 1
    assert run("health") == 0
    assert run("init") == 0 and run("init") == 1
    assert cli.main(["nonsense"], spark) == 64
    assert "neverCalled" in capsys.readouterr().out
