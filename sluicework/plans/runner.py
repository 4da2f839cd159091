"""Runs: choice of rules, suppression, total order, statistics, baseline and gates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import paths as P
from ..operators import diff, health
from ..sources.config import Config
from ..sources.project import Project
from ..reporters import ordered  # noqa: F401
from . import rules as R


@dataclass
class Outcome:
    """findings in no order (see `ordered`), how many were suppressed, the rules that ran, and their version."""

    findings: DataFrame
    suppressed: int
    rules: list[str]
    version: str


def active(config: Config, category: str | None = None, registry=R.REGISTRY) -> list[str]:
    """Rules that run: those of the category that aren't switched off. Others are never planned."""
    return [r for r, c, _ in registry if config.rules.get(r, True) and (config.a11y or c != "accessibility") and category in (None, c)]


def analyse(project: Project, config: Config | None = None, category: str | None = None) -> Outcome:
    config = config or Config()
    chosen = active(config, category)
    spark = project.files.sparkSession
    found = [R.RULES[r](project, config.source_dirs) for r in chosen]
    raw = reduce(DataFrame.unionByName, found) if found else R.empty(spark)
    raw = raw.persist()
    kept = diff.band_anti(raw, R.directives(project), ["file_path", "rule_id"]).select(*R.COLUMNS)
    if config.ignore:
        kept = kept.where(~P.matches_any(F.col("file_path"), config.ignore))
    kept = kept.persist()
    ids = [r for r, c, _ in R.REGISTRY if category in (None, c)]
    return Outcome(kept, raw.count() - kept.count(), chosen, I.ruleset_version_of(ids))


def stats(project: Project) -> DataFrame:
    return scan_stats(project.files.where("status = 'ok'"), P.under_lib(F.col("path")), F.col("lines"))


def scan_stats(files: DataFrame, in_lib: Column, lines: Column) -> DataFrame:
    """One row: files, those in lib, and lines."""
    return files.agg(F.count("*").alias("files"), F.count_if(in_lib).alias("lib_files"), F.coalesce(F.sum(lines), F.lit(0)).alias("lines"))


def project_health(project: Project, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(score row, the worst bodies). Rule choices and suppressions have no say in it."""
    rows = R.complexity(project, (config or Config()).source_dirs).persist()
    return health.health(rows), health.worst(rows)


def gate(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return diff.ratchet(diff.baseline_diff(findings.select("fingerprint"), baseline.select("fingerprint")))
