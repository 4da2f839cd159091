"""Source trees as tables: files, facts and the project's profile."""

from __future__ import annotations

import gc
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frontend.parser import FACT_COLUMNS, parse
from ..functions import paths as P
from ..session import spread, stored
from . import yaml

DIRS = ("lib", "bin", "test", "tool")
_NAMES = [c.split()[0] for c in FACT_COLUMNS.split(", ")]
#: Manifests that one task reads.
TASK_MANIFESTS = 20_000
#: Facts with what a rule must know of their file.
_STORED = FACT_COLUMNS + ", is_part boolean"
_ARROW = [{"string": pa.string(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}[c.split()[1]] for c in FACT_COLUMNS.split(", ")]
#: Facts and tokens that a task holds before it passes them on.
_HELD = 20_000, 500_000
GENERATORS = frozenset("source_gen build_runner riverpod_generator retrofit_generator freezed mobx_codegen json_serializable injectable_generator hive_generator".split())


@dataclass(frozen=True)
class Profile:
    """What the manifest says. Without one a project counts as publishable."""

    package: str = ""
    generators: tuple[str, ...] = ()
    is_flutter: bool = False
    is_publishable: bool = True


@dataclass
class Project:
    """files: path, content, is_generated, is_part, status, reason, lines; facts: see `frontend.parser`, with is_part.

    kinds: which facts there are besides those of files; None for all.
    """

    root: str
    profile: Profile
    files: DataFrame
    facts: DataFrame
    kinds: frozenset[str] | None = None

    def errors(self) -> DataFrame:
        """Files that can't be parsed, but for parts: their library's row says enough."""
        return self.files.where("status = 'error' and not is_part").select("path", "reason")


def read_profile(root: str) -> Profile:
    path = os.path.join(root, "pubspec.yaml")
    if not os.path.isfile(path):
        return Profile()
    try:
        with open(path, encoding="utf-8") as f:
            return profile_of(f.read())
    except (OSError, UnicodeDecodeError):
        return Profile()


def profile_of(manifest: str) -> Profile:
    """The profile of a manifest's text; of one that can't be read, that of none."""
    try:
        top = yaml.load(manifest)
    except yaml.YamlError:
        return Profile()
    if not isinstance(top, dict):
        return Profile()
    section = lambda name: top[name] if isinstance(top.get(name), dict) else {}
    name = top.get("name")
    return Profile(name if isinstance(name, str) else "", tuple(sorted(g for g in section("dev_dependencies") if g in GENERATORS)), "flutter" in section("dependencies"), top.get("publish_to") != "none")


def profiles(manifests: DataFrame, key: str, manifest: str) -> DataFrame:
    """(key, package, generators, is_flutter, is_publishable) of many manifests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [profile_of(x or "") for x in frame[manifest]]
            yield pd.DataFrame({key: frame[key], "package": [x.package for x in found], "generators": [",".join(x.generators) for x in found], "is_flutter": [x.is_flutter for x in found], "is_publishable": [x.is_publishable for x in found]})

    kind = manifests.schema[key].dataType.simpleString()
    return spread(manifests.select(key, manifest), key, TASK_MANIFESTS).mapInPandas(run, f"{key} {kind}, package string, generators string, is_flutter boolean, is_publishable boolean")


def _facts(package: str, kinds: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # facts make no cycles, and their number would set it off again and again
        try:
            yield from some(batches)
        finally:
            gc.enable()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens = [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = parse(path, content, kinds)
                part = found[-1]["props"]["part"] == "true"
                for fact in found:
                    if fact["fact"] == "uri":
                        fact["props"]["target"] = resolve(path, fact["props"]["uri"], package)
                    fact["is_part"] = part
                    tokens += len(fact["items"])
                rows += found
                if len(rows) > _HELD[0] or tokens > _HELD[1]:
                    yield _batch(rows)
                    rows, tokens = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """Facts by kind, so that a reader of one kind can skip the others' pages."""
    rows.sort(key=lambda r: r["fact"])
    cols = [pa.array([r[n] for r in rows], kind) for n, kind in zip(_NAMES, _ARROW) if n not in ("props", "items")]
    maps = pa.array([list(r["props"].items()) for r in rows], _ARROW[_NAMES.index("props")])
    items = pa.array([r["items"] for r in rows], _ARROW[_NAMES.index("items")])
    return pa.RecordBatch.from_arrays([*cols, maps, items, pa.array([r["is_part"] for r in rows], pa.bool_())], names=[*_NAMES, "is_part"])


def resolve(path: str, uri: str, package: str) -> str:
    """The project file that a URI names, or '' for one outside the project."""
    if uri.startswith("package:"):
        own = f"package:{package}/"
        return "lib/" + uri[len(own) :] if package and uri.startswith(own) else ""
    if ":" in uri.split("/")[0] or not uri:
        return ""
    target = posixpath.normpath(posixpath.join(posixpath.dirname(path), uri))
    return "" if target.startswith("..") else target


def facts_of(files: DataFrame, package: str = "", kinds: frozenset[str] | None = None) -> DataFrame:
    """Facts of a table (path, content)."""
    return files.select("path", "content").mapInArrow(_facts(package, kinds), _STORED)


def from_files(files: DataFrame, profile: Profile = Profile(), root: str = "", kinds: tuple[str, ...] | None = None, even: bool = False) -> Project:
    """A project of a table (path, content). Files are parsed once: all rules read the stored facts.

    kinds: the facts that are asked for, all by default. even: whether the files already lie in tasks of bounded size.
    """
    kinds = None if kinds is None else frozenset(kinds)
    files = files if even else spread(files, "path")
    facts = stored(facts_of(files, profile.package, kinds))
    state = facts.where("fact = 'file'").select("path", F.col("name").alias("status"), "is_part", F.col("props")["reason"].alias("reason"), F.col("end_line").alias("lines"))
    full = files.select("path", "content").join(state, "path").withColumn("is_part", F.coalesce("is_part", F.lit(False)))
    return Project(root, profile, full.withColumn("is_generated", P.generated(F.col("path"))), facts, kinds)


def load(spark: SparkSession, root: str) -> Project:
    """The Dart files below lib, bin, test and tool of a project. A missing root is one error row."""
    schema = "path string, content string"
    if not os.path.isdir(root):
        lost = spark.createDataFrame([(root, None)], schema)
        return from_files(lost, Profile(), root)
    root = os.path.abspath(root)
    dirs = [os.path.join(root, d) for d in DIRS if os.path.isdir(os.path.join(root, d))]
    if not dirs:
        return from_files(spark.createDataFrame([], schema), read_profile(root), root)
    # one row for each file; the Python parser reads them where they lie
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.dart").format("binaryFile").load(dirs)
    path = F.regexp_replace("path", "^file:/*", "/")
    files = rows.select(F.substr(path, F.lit(len(root) + 2)).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return from_files(files, read_profile(root), root)
