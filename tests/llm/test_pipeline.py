"""The pipeline against brute force over a small table, and the queries against their SQL."""

import duckdb
import pytest
import tiktoken
from test_line_dedup import brute as dedup
from test_ngram_jaccard import brute as classes

import __spark_entry__
import corpus_pipeline
from sluicework.llm import bpe, mixing, toxicity
from sluicework.llm import queries as Q
from sluicework.llm.common import table
from sluicework.llm.secrets import PATTERN


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append((name, docs.collect()))
        assert name == "byte_bpe" or docs.columns == columns
    before = table(spark, sf_dir, "documents").collect()
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    clean = [r for r in before if round(model.score_one(r.text)[0], 6) <= 0]
    got = dict(steps)
    ids = lambda rows: sorted(r.doc_id for r in rows)
    assert ids(got["toxicity"]) == ids(clean) and len(clean) < len(before)
    rows = [(r.doc_id, r.text) for r in got["toxicity"]]
    want = {i: t for (i, old), (t, n) in zip(rows, dedup(rows)) if not (n and not t.strip())}
    assert {r.doc_id: r.text for r in got["line_dedup"]} == want
    assert ids(got["ngram_jaccard_join"]) == sorted(i for i, (c, _) in classes(list(want.items())).items() if c == i)
    tokens = {r.doc_id: len(r.text.split()) for r in got["ngram_jaccard_join"]}
    assert set(ids(got["mixing"])) <= set(tokens) and len(got["mixing"]) > 0.9 * len(tokens)
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    assert all(r.round_trip and r.tokens == enc.encode_ordinary(r.text) for r in got["byte_bpe"])
    assert ids(got["byte_bpe"]) == ids(got["mixing"]) and mixing.SEED == 17


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns)
    a, b = (x.round(9).astype(str).sort_values(key).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_every_query_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in Q.QUERIES}
    assert numbers == set(range(1, 11)) and "pipeline" in __spark_entry__.queries()
