"""Frozen findings as JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
NAME = "sluicework-baseline.json"
SCHEMA = "fingerprint string, rule_id string, file_path string, line int, message string"
_FIELDS = (("fingerprint", str), ("ruleId", str), ("filePath", str), ("line", int), ("message", str))


class BaselineError(ValueError):
    pass


def write(path: str, findings: DataFrame, ruleset: str) -> int:
    """Writes the findings in their total order; the result is their number."""
    rows = findings.select("fingerprint", "rule_id", "file_path", "line", "message").orderBy("file_path", "line", "fingerprint").collect()
    body = {"schemaVersion": VERSION, "rulesetVersion": ruleset, "findings": [dict(zip((n for n, _ in _FIELDS), r)) for r in rows]}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(body, indent=2, ensure_ascii=False) + "\n")
    return len(rows)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(findings, ruleset version); errors name what is wrong with the file. A finding's missing fields are '' or 0."""
    if not os.path.isfile(path):
        raise BaselineError("there is no baseline")
    try:
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
    except ValueError as e:
        raise BaselineError(f"the baseline can't be read: {e}") from e
    if not isinstance(body, dict) or not all(isinstance(body.get(n), k) for n, k in (("schemaVersion", int), ("rulesetVersion", str), ("findings", list))):
        raise BaselineError("the baseline lacks schemaVersion, rulesetVersion or findings")
    if body["schemaVersion"] != VERSION:
        raise BaselineError(f"schema version {body['schemaVersion']} isn't known")
    rows = []
    for x in body["findings"]:
        if not isinstance(x, dict) or not all(x.get(n) is None or isinstance(x[n], k) for n, k in _FIELDS):
            raise BaselineError("a finding has a field of the wrong type")
        rows.append(tuple(k() if x.get(n) is None else x[n] for n, k in _FIELDS))
    return spark.createDataFrame(rows, SCHEMA), body["rulesetVersion"]
