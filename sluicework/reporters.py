"""Renderers. What is said of a finding is a column; the driver only puts the texts together that a report shows."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .functions.scores import pad
from .operators import report
from .operators.report import SEVERITIES

SCHEMA_VERSION = 3
PROMPT = "prompt@v2"
COLOURS = {"error": "31", "warning": "33", "info": "36"}
HINTS = {
    "circular-dependencies": "Break the cycle by moving shared declarations to a file of their own.",
    "code-duplicates": "Replace the copies by one function.",
    "complexity-hotspots": "Split the function; keep its behaviour.",
    "unused-public-exports": "Remove the declaration if no other package uses it.",
}
GENERIC = "Fix the finding without changing behaviour."
TEMPLATE = f"""# Repairs ({PROMPT})

Project: `{{target}}`. Paths are relative to its root.

## What was found

{{findings}}

## How to go about it

* Repair what is listed, and nothing else.
* Keep the style of the code around it.
* Where only a larger change helps, describe it and make the smallest one that is safe.
"""


@dataclass
class Payload:
    """What a report shows. findings: rows with the columns of a finding."""

    findings: DataFrame
    root: str
    ruleset: str
    is_tty: bool = False
    suppressed: int = 0
    stats: dict | None = None
    rules: list[str] = field(default_factory=list)
    health: tuple[dict, DataFrame] | None = None

    def summary(self) -> dict[str, int]:
        return report.severity_summary(self.findings).first().asDict()

    def target(self) -> str:
        """The project's name, which is the same wherever it lies."""
        return os.path.basename(self.root.rstrip("/")) or "this project"


def ordered(findings: DataFrame) -> DataFrame:
    """The total order of findings."""
    return findings.orderBy("file_path", *report.ORDER)


def human_blocks(findings: DataFrame, is_tty: bool = False) -> DataFrame:
    """(file_path, n, text): the lines of each file."""
    return report.grouped_text(findings, "file_path", report.ORDER, report.human_line(COLOURS if is_tty else None))


def human(p: Payload) -> str:
    out = [line for r in human_blocks(p.findings, p.is_tty).orderBy("file_path").collect() for line in (r.file_path, r.text, "")]
    out.append(report.summary_line(p.findings).first().text)
    if p.suppressed:
        out.append(f"{p.suppressed} suppressed")
    return "\n".join(out) + "\n"


def as_json(p: Payload) -> str:
    body = {"schemaVersion": SCHEMA_VERSION, "tool": {"name": "sluicework", "version": __version__}, "ruleset": p.ruleset, "summary": p.summary() | {"suppressed": p.suppressed}}
    if p.stats is not None:
        body["scan"] = p.stats | {"rules": p.rules}
    rows = ordered(p.findings).select(report.json_finding().alias("row")).collect()
    return json.dumps(body | {"findings": [json.loads(r.row) for r in rows]}, indent=2, ensure_ascii=False) + "\n"


def sarif_results(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule_id, rule_index) of the rules in the order of their first findings, and findings with their ``result``."""
    rules = report.catalogue(findings, "rule_id", ["file_path", *report.ORDER])
    return rules, findings.join(rules, "rule_id").withColumn("result", report.sarif_result(F.col("rule_index")))


def sarif(p: Payload) -> str:
    rules, results = sarif_results(p.findings)
    driver = {"name": "sluicework", "version": __version__, "rules": [{"id": r.rule_id} for r in rules.orderBy("rule_index").collect()]}
    rows = [json.loads(r.result) for r in ordered(results).select("result").collect()]
    run = {"tool": {"driver": driver}, "results": rows, "properties": {"ruleset": p.ruleset, "suppressed": p.suppressed}}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False) + "\n"


def markdown_blocks(findings: DataFrame) -> DataFrame:
    """(file_path, n, text): the table rows of each file."""
    return report.grouped_text(findings, "file_path", report.ORDER, report.markdown_row())


def markdown(p: Payload) -> str:
    out = ["# Findings", ""]
    for r in markdown_blocks(p.findings).orderBy("file_path").collect():
        out += [f"## {r.file_path}", "", "| Line | Severity | Rule | Message | Remedy |", "| --- | --- | --- | --- | --- |", r.text, ""]
    s = p.summary()
    return "\n".join([*out, "**" + ", ".join(f"{k}: {v}" for k, v in s.items()) + f", suppressed: {p.suppressed}**"]) + "\n"


def prompt_text(findings: DataFrame, sep: str = "\n\n") -> DataFrame:
    """(text): the entries of all findings in their order, null without any."""
    return report.joined_text(findings, ["file_path", *report.ORDER], report.prompt_entry(HINTS, GENERIC), sep)


def fix_prompt(p: Payload) -> str:
    """The text that asks for repairs of the findings."""
    return TEMPLATE.format(target=p.target(), findings=prompt_text(p.findings).first().text or "(no findings selected)")


_SCRIPT = """
const rows = JSON.parse(document.getElementById('data').textContent).findings;
const prompt = JSON.parse(document.getElementById('ask').textContent), chosen = new Set();
const box = document.getElementById('list'), find = document.getElementById('find'), by = document.getElementById('by'), sev = document.getElementById('sev');
function draw() {
  const q = find.value.toLowerCase();
  const kept = rows.filter(f => (!sev.value || f.severity === sev.value) && `${f.filePath} ${f.ruleId} ${f.message}`.toLowerCase().includes(q));
  const groups = new Map();
  for (const f of kept) { const k = f[by.value]; groups.set(k, [...(groups.get(k) || []), f]); }
  box.replaceChildren();
  document.getElementById('n').textContent = kept.length + ' of ' + rows.length;
  for (const [k, fs] of groups) {
    const h = document.createElement('h3'); h.textContent = k + ' (' + fs.length + ')'; box.append(h);
    for (const f of fs) {
      const d = document.createElement('label'), c = document.createElement('input'); c.type = 'checkbox'; c.checked = chosen.has(f);
      c.addEventListener('change', () => { c.checked ? chosen.add(f) : chosen.delete(f); ask(); });
      d.append(c, f.filePath + ':' + f.line + ' ' + f.severity + ' ' + f.message); box.append(d, document.createElement('br'));
    }
  }
}
function ask() {
  const entries = rows.filter(f => chosen.has(f)).map(f => '* ' + f.filePath + ':' + f.line + ' (' + f.ruleId + '): ' + f.message + '\\n  Hint: ' + (prompt.hints[f.ruleId] || prompt.generic));
  document.getElementById('prompt').value = prompt.template.replace('{findings}', () => entries.join('\\n\\n') || '(no findings selected)');
}
ask();
for (const e of [find, by, sev]) e.addEventListener('input', draw);
draw();
"""


def as_html(p: Payload) -> str:
    safe = lambda x: x.replace("</", "<\\/")
    data = safe(as_json(p))
    ask = safe(json.dumps({"template": TEMPLATE.replace("{target}", p.target()), "hints": HINTS, "generic": GENERIC}))
    badge = f"<p>Health {p.health[0]['score']} ({p.health[0]['grade']})</p>" if p.health else ""
    s = p.summary()
    bar = "".join(f'<span class="{k}">{k}: {s[k]}</span> ' for k in SEVERITIES)
    rules = report.facet_counts(p.findings.select("rule_id"), ["rule_id"]).orderBy(F.desc("n"), "value").collect()
    table = "".join(f"<tr><td>{html.escape(r.value)}</td><td>{r.n}</td></tr>" for r in rules)
    pick = "".join(f"<option>{x}</option>" for x in ("ruleId", "severity", "filePath"))
    levels = "<option></option>" + "".join(f"<option>{x}</option>" for x in SEVERITIES)
    return f"""<!doctype html><meta charset="utf-8"><title>{html.escape(p.target())}</title>
<h1>{html.escape(p.target())}</h1>{badge}<p>{bar}suppressed: {p.suppressed}</p><table>{table}</table>
<p><input id="find" placeholder="search"> <select id="by">{pick}</select> <select id="sev">{levels}</select> <span id="n"></span></p>
<div id="list"></div><textarea id="prompt" rows="12" cols="100" readonly></textarea>
<script type="application/json" id="data">{data}</script><script type="application/json" id="ask">{ask}</script><script>{_SCRIPT}</script>
"""


def health_lines(worst: DataFrame) -> DataFrame:
    """worst with ``text``, its line of the table."""
    where = F.concat(F.col("file_path"), F.lit(":"), F.col("line").cast("string"))
    number = lambda c: pad(F.col(c).cast("string"), 5, left=True)
    return worst.withColumn("text", F.concat(pad(F.col("qualified_name"), 38), pad(where, 30), number("cyclomatic"), number("cognitive")))


def health_table(score: dict, worst: DataFrame) -> str:
    out = [f"Health {score['score']} ({score['grade']}), {score['n']} bodies", "", "function".ljust(38) + "file".ljust(30) + "cyc".rjust(5) + "cog".rjust(5)]
    rows = health_lines(worst).orderBy(F.desc("magnitude"), "file_path", "line", "qualified_name").select("text").collect()
    return "\n".join([*out, *(r.text for r in rows)]) + "\n"


REPORTERS: dict[str, Callable[[Payload], str]] = {"human": human, "json": as_json, "sarif": sarif, "markdown": markdown, "html": as_html}


def render(kind: str, payload: Payload) -> str:
    if kind not in REPORTERS:
        raise ValueError(f"no reporter is called {kind}")
    return REPORTERS[kind](payload)
