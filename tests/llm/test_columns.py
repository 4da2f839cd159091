"""Columns of any name and type, and odd or empty tables, through every operator that passes columns on and through the pipeline."""

import datetime
import decimal

import pytest

import corpus_pipeline
from sluicework.llm import bpe, language_id, line_dedup, mixing, ngram_jaccard, quality, toxicity, url_filter
from sluicework.llm.common import table

KINDS = "doc_id long, text string, lang string, source string, n_chars long, `a b` struct<`x y`:int,`z``z`:array<int>>, `p.q` decimal(20,3), Score map<string,array<int>>, N_Lines string, c0 timestamp_ntz, `__text` binary, d1 date, Keep boolean, url string, `id` double, `tokens2` string"


@pytest.fixture(scope="module")
def wide(spark, odd):
    rest = ((1, [2, None]), decimal.Decimal("1.250"), {"k": [1, None]}, "n", datetime.datetime(2024, 1, 2, 3, 4, 5), b"\\x00", datetime.date(2024, 1, 1), True, "http://a.b/free", 0.5, "t")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *(rest if k % 2 else (None,) * len(rest))) for k, r in enumerate(odd.collect())]
    return spark.createDataFrame(rows, KINDS)


def kept(df, names):
    return sorted(str([str(r[n]) for n in names]) for r in df.select(*[f"`{n}`" for n in names]).collect())


def through(docs):
    model = toxicity.Model([("a calm text", 0), ("you idiot", 1)] * 9)
    yield bpe.encode_documents(docs), ()
    yield bpe.decode_documents(bpe.encode_documents(docs)).drop("tokens", "n_tokens", "round_trip"), ()
    yield toxicity.score_toxicity(docs, model), ("Score",)
    yield quality.score_quality(docs, quality.fit(docs, docs)), ("Score", "Keep")
    yield language_id.label_words(docs, language_id.fit(docs)), ()
    yield url_filter.filter_urls(docs), ()
    yield line_dedup.line_dedup(docs), ("N_Lines", "text")


def test_other_columns_pass_unchanged(wide):
    for out, replaced in through(wide):
        names = [n for n in wide.columns if n not in replaced]
        assert [n for n in out.columns if n in names] and not {x.lower() for x in replaced} - {"text"} & {n.lower() for n in names}
        assert {f.name: f.dataType for f in out.schema.fields if f.name in names} == {f.name: f.dataType for f in wide.schema.fields if f.name in names}
        assert kept(out, names) == kept(wide, names)
        assert len({n.lower() for n in out.columns}) == len(out.columns)
    for out, _ in through(wide.limit(0)):
        assert out.count() == 0


def test_filters_keep_columns_and_types(wide):
    for run in (line_dedup.without_repeats, ngram_jaccard.near_duplicates, mixing.mixed):
        out = run(wide)
        assert out.dtypes == wide.dtypes
        assert run(wide.limit(0)).count() == 0


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_pipeline_on_odd_and_empty_tables(spark, sf_dir, wide, tmp_path, rows):
    docs = wide if rows == "odd" else wide.limit(0)
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "byte_bpe" or docs.dtypes == columns
    assert {"tokens", "n_tokens", "round_trip"} <= set(docs.columns)
    ids = [r.doc_id for r in docs.collect()]
    if rows == "empty":
        assert ids == []
    else:  # 2 and 3 are copies of 1; nothing else is rejected
        assert 1 in ids and 9 in ids and 10 in ids and not {2, 3} & set(ids) and all(r.round_trip for r in docs.collect())


def test_clean_only_on_odd_tables(spark, sf_dir, wide):
    out = toxicity.clean_only(spark, wide, sf_dir)
    assert out.dtypes == wide.dtypes and kept(out, wide.columns) == kept(wide, wide.columns)
    assert toxicity.clean_only(spark, wide.limit(0), sf_dir).count() == 0
    assert table(spark, sf_dir, "documents").columns == ["doc_id", "text", "lang", "source", "n_chars"]
