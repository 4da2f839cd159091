"""The corpus pipeline: toxicity, line dedup, near duplicates, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and reread as the next stage's docs. All but the last return the columns of documents. No SQL is given: the
toxicity model, the edit-distance join and the encoding can't be expressed on whole tables, so the pipeline is tested
against brute force.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns of any
name: what becomes of such rows is stated in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluicework.llm import bpe, common, line_dedup, mixing, ngram_jaccard, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents.

    Null, empty and wordless texts aren't toxic and stay, null ids too; equal texts are judged alike, texts of any length
    as a whole. Columns stay as they are; an empty table stays empty.
    """
    return toxicity.clean_only(spark, docs, sf_dir)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines with an earlier equal or near-equal line, and documents that have nothing left after it.

    Documents that had no words before, null texts and rows with null ids stay as they are; repeated rows tie and keep the
    same lines. n_chars follows the text, other columns stay; an empty table stays empty.
    """
    return line_dedup.without_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near duplicates.

    Null, empty and wordless texts are in no class and stay, null ids too; rows repeated under one id stay or go
    together. Columns stay as they are; an empty table stays empty.
    """
    return ngram_jaccard.near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, leaves out and permutes documents in blocks so that the sources have their target weights.

    A null source is a source of its own; texts without tokens take part with none; rows with null ids tie, and repeated
    rows are taken together. Columns stay as they are; an empty table stays empty.
    """
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the tokens of each text, their number and whether decoding gives the text back.

    A null text has null tokens, an empty one none. The three names replace columns that have them; repeated rows stay, as
    does an empty table.
    """
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each over all rows that the one before kept."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
