"""Command line: scan, slop, a11y, health, gate, baseline, init, version. Exit codes: 0, 1 findings, 64 usage, 78 config."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import __version__, reporters
from .operators import diff
from .plans import runner
from .plans.rules import RULES
from .sources import baseline, config, project

USAGE, CONFIG = 64, 78


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        print(message, file=sys.stderr)
        raise SystemExit(USAGE)


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="sluicework")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True, parser_class=_Parser)
    for name in ("scan", "slop", "a11y", "health", "gate", "baseline", "init", "fix"):
        c = sub.add_parser(name)
        c.add_argument("root", nargs="?")
        c.add_argument("--project-root")
        if name in ("scan", "slop", "a11y", "gate"):
            c.add_argument("--reporter", default="human", choices=sorted(reporters.REPORTERS))
            c.add_argument("--output")
        if name == "gate":
            c.add_argument("--absolute", action="store_true")
        if name == "baseline":
            c.add_argument("--write", action="store_true")
            c.add_argument("--update", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    root = os.path.abspath(args.project_root or args.root or os.getcwd())
    if args.command == "init":
        done = config.scaffold(root)
        print("Written." if done else "There is a configuration already.")
        return 0 if done else 1
    if args.command == "fix":
        print("Not offered.", file=sys.stderr)
        return 0
    try:
        settings = config.discover(root, RULES)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return CONFIG
    spark = spark or SparkSession.builder.appName("sluicework").getOrCreate()
    return _run(args, root, settings, spark)


def _run(args, root: str, settings: config.Config, spark: SparkSession) -> int:
    place = os.path.join(root, baseline.NAME)
    frozen = None
    if args.command == "gate" and not args.absolute or args.command == "baseline" and not (args.write or args.update):
        try:
            frozen = baseline.read(spark, place)
        except baseline.BaselineError as e:
            print(f"{e}; write one with: baseline --write", file=sys.stderr)
            return 1
    if args.command == "baseline" and frozen:
        for r in reporters.ordered(frozen[0]).collect():
            print(f"{r.file_path}:{r.line} {r.rule_id} {r.message}")
        return 0
    code = project.load(spark, root)
    if args.command == "health":
        score, worst = runner.project_health(code, settings)
        print(reporters.health_table(score.first().asDict(), worst), end="")
        return 0
    out = runner.analyse(code, settings, {"slop": "slop", "a11y": "accessibility"}.get(args.command))
    if args.command == "baseline":
        print(f"{baseline.write(place, out.findings, out.version)} findings are frozen.")
        return 0
    # a report shows all findings, so their texts come to the driver
    payload = reporters.Payload(out.findings, root, out.version, not args.output and sys.stdout.isatty(), out.suppressed, runner.stats(code).first().asDict(), out.rules)
    if args.reporter == "html":
        score, worst = runner.project_health(code, settings)
        payload.health = (score.first().asDict(), worst)
    text = reporters.render(args.reporter, payload)
    target = args.output or (os.path.join(root, "sluicework-report.html") if args.reporter == "html" else None)
    if target:
        with open(target, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, end="")
    for e in code.errors().orderBy("path").collect():
        print(f"{e.path}: {e.reason}", file=sys.stderr)
    if args.command != "gate" or args.absolute:
        return int(not diff.absolute(out.findings).first().passed)
    if frozen[1] != out.version:
        print(f"The baseline is of {frozen[1]}, this is {out.version}.", file=sys.stderr)
    result = runner.gate(out.findings, frozen[0]).first()
    print(f"new: {result.new_count}, kept: {result.kept_count}, fixed: {result.fixed_count}")
    return 0 if result.passed else 1


if __name__ == "__main__":
    sys.exit(main())
