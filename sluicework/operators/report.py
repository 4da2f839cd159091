"""Relational parts of reports: summaries, catalogues, grouped and escaped texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import pad, plural

SEVERITIES = ("error", "warning", "info")
SARIF = {"error": "error", "warning": "warning", "info": "note"}


def severity_summary(rows: DataFrame, severity: str = "severity") -> DataFrame:
    """One row of counts, 0 for severities that don't occur."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(severity) == s).alias(s) for s in SEVERITIES])


def sarif_level(severity: Column) -> Column:
    out = F.when(severity == "error", "error")
    for s in ("warning", "info"):
        out = out.when(severity == s, SARIF[s])
    return out.otherwise("none")


def catalogue(rows: DataFrame, rule: str, ordinal: list[str]) -> DataFrame:
    """(rule, rule_index): distinct rules in the order of their first row."""
    first = rows.groupBy(rule).agg(F.min(F.struct(*ordinal)).alias("__first"))
    packed = first.agg(F.sort_array(F.collect_list(F.struct("__first", rule))).alias("__all"))
    return packed.select(F.posexplode("__all").alias("rule_index", "__one")).select(F.col(f"__one.{rule}").alias(rule), "rule_index")


def escape_cell(text: Column) -> Column:
    """Text of a Markdown table cell."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


# columns of findings, see `plans.rules.COLUMNS`

ORDER = ["line", "fingerprint"]


def place(line: Column, column: Column) -> Column:
    return F.concat_ws(":", line.cast("string"), column.cast("string"))


def human_line(colours: dict[str, str] | None = None) -> Column:
    """A finding as a line of the report for people."""
    severity = F.col("severity")
    shown = severity
    for s, code in (colours or {}).items():
        shown = F.when(severity == s, F.concat(F.lit(f"\x1b[{code}m"), severity, F.lit("\x1b[0m"))).otherwise(shown)
    note = F.when(F.col("wcag").isNotNull(), F.concat(F.lit(" (WCAG "), F.col("wcag.number"), F.lit(" "), F.col("wcag.title"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("  "), pad(place(F.col("line"), F.col("column")), 8), F.lit(" "), shown, F.lit("  "), F.col("rule_id"), F.lit("  "), F.col("message"), note)


def markdown_row() -> Column:
    cells = [F.col("line").cast("string"), F.col("severity"), F.col("rule_id"), escape_cell(F.col("message")), escape_cell(F.coalesce("remedy", F.lit("—")))]
    return F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))


def json_finding() -> Column:
    """A finding as JSON: missing values are null, but a missing guideline is left out."""
    names = (("rule_id", "ruleId"), ("severity", "severity"), ("file_path", "filePath"), ("line", "line"), ("column", "column"), ("message", "message"), ("kind", "kind"), ("remedy", "remedy"), ("fingerprint", "fingerprint"))
    body = F.to_json(F.struct(*[F.col(a).alias(b) for a, b in names]), {"ignoreNullFields": "false"})
    note = F.to_json("wcag")
    return F.when(note.isNull(), body).otherwise(F.concat(F.left(body, F.length(body) - 1), F.lit(',"wcagRef":'), note, F.lit("}")))


def sarif_result(index: Column) -> Column:
    """A finding as a SARIF result: what is missing is left out. index: of its rule in the catalogue."""
    region = F.struct(F.greatest(F.lit(1), F.col("line")).alias("startLine"), F.col("column").alias("startColumn"))
    at = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    extra = F.when(F.coalesce("kind", "remedy", F.to_json("wcag")).isNotNull(), F.struct("kind", "remedy", "wcag"))
    prints = F.struct(F.col("fingerprint").alias("sluicework/v1"))
    parts = [F.col("rule_id").alias("ruleId"), index.alias("ruleIndex"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(at).alias("locations")]
    return F.to_json(F.struct(*parts, prints.alias("partialFingerprints"), extra.alias("properties")))


def summary_line(rows: DataFrame) -> DataFrame:
    """(text): the number of findings, with those severities that occur."""
    n = severity_summary(rows)
    some = F.concat_ws(", ", *[F.when(F.col(s) > 0, F.concat(F.lit(f"{s}: "), F.col(s).cast("string"))) for s in SEVERITIES])
    return n.select(F.when(F.col("total") == 0, "No findings").otherwise(F.concat(plural(F.col("total"), "finding"), F.lit(" ("), some, F.lit(")"))).alias("text"))


def hint(rule: Column, hints: dict[str, str], generic: str) -> Column:
    """What to do about a rule's findings; a general word for rules without one of their own."""
    known = F.create_map(*[F.lit(x) for pair in hints.items() for x in pair])
    return F.coalesce(known[rule], F.lit(generic))


def prompt_entry(hints: dict[str, str], generic: str) -> Column:
    """A finding in the text that asks for its repair."""
    where = F.concat(F.col("file_path"), F.lit(":"), F.col("line").cast("string"))
    return F.concat(F.lit("* "), where, F.lit(" ("), F.col("rule_id"), F.lit("): "), F.col("message"), F.lit("\n  Hint: "), hint(F.col("rule_id"), hints, generic))


def grouped_text(rows: DataFrame, group: str, order: list[str], text: Column, sep: str = "\n") -> DataFrame:
    """(group, n, text): the rows' texts joined in order."""
    packed = rows.groupBy(group).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*order, text.alias("__t")))).alias("__all"))
    return packed.select(group, "n", F.array_join(F.col("__all.__t"), sep).alias("text"))


def _pieces(sep: str):
    """Sorted texts to (part, n, rows, text): the texts of each batch joined, with the numbers of their task and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            texts = batch.column(0).drop_null().to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (part, n, batch.num_rows, len(texts))] + [pa.array([sep.join(texts)])], names=["part", "n", "rows", "texts", "text"])

    return run


def _whole(sep: str):
    """All pieces to one row. The text is put together once, from bytes, and handed on without a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = {}, 0
        for batch in batches:
            part, n, count, texts = (batch.column(k).to_pylist() for k in range(4))
            rows += sum(count)
            for k in range(batch.num_rows):
                if texts[k]:
                    held[part[k], n[k]] = batch.column(4)[k].as_buffer().to_pybytes()
        keys = sorted(held)
        size = sum(map(len, held.values())) + len(sep.encode()) * max(0, len(keys) - 1)
        if size >= 2**31:
            raise OverflowError(f"a text of {size} bytes: a value holds less than 2 GB")
        out = bytearray(size)
        at = 0
        for k, key in enumerate(keys):
            piece = held.pop(key) if not k else sep.encode() + held.pop(key)
            out[at : at + len(piece)] = piece
            at += len(piece)
        offsets = np.array([0, size], np.int32)
        text = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)]) if rows else pa.nulls(1, pa.string())
        yield pa.RecordBatch.from_arrays([text], names=["text"])

    return run


def joined_text(rows: DataFrame, order: list[str], text: Column, sep: str) -> DataFrame:
    """(text): one row with the rows' texts joined in order, null without any rows.

    Rows are sorted and joined in many tasks; one task only puts the pieces together, so that it holds the text itself twice
    at most and no row.
    """
    lines = rows.select(*order, text.alias("__t")).orderBy(*order, "__t").select("__t")
    shape = "part int, n int, rows int, texts int, text string"
    none = rows.sparkSession.range(1).selectExpr("-1 part", "0 n", "0 rows", "0 texts", "'' text")
    return lines.mapInArrow(_pieces(sep), shape).union(none).repartition(1).mapInArrow(_whole(sep), "text string")


def facet_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) of all facets in one aggregate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    return rows.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def search(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined by blanks in lower case, contain the lower-cased needle."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower())))
