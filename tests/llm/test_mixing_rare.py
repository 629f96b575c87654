"""Very rare sources meet their target weight in the mixing query and in the pipeline's stage."""

import collections

import duckdb
import pytest

import corpus_pipeline
from tidemill.llm import mixing, queries
from tidemill.llm.common import scratch


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "x" * 99, "a" if i % 2 else "b") for i in range(6000)] + [(6000 + i, "x" * 99, "few") for i in range(40)] + [(7000, "x" * 99, "one")]
    sf_dir = scratch(spark, "test-mixing")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{sf_dir}/documents.parquet")
    return sf_dir


def test_rare_sources_reach_their_weight(spark, corpus):
    got = queries.op7_mixing(spark, corpus)
    rates = {r["source"]: r["rate"] for r in got.select("source", "rate").distinct().collect()}
    assert rates["one"] == round(6041 / 4, 9) and rates["few"] == round(6041 / 4 / 40, 9)
    counts = collections.Counter(r["source"] for r in got.collect())
    for n in counts.values():
        assert abs(n - 6041 / 4) < 5 * (6041 / 4) ** 0.5
    assert len(counts) == 4
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    staged = collections.Counter(r["source"] for r in corpus_pipeline.source_mix(spark, docs, corpus).collect())
    assert staged == counts


def test_rare_sources_equal_the_sql(spark, corpus):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{corpus.removeprefix('file://')}/documents.parquet/*.parquet'")
    columns = ["doc_id", "source", "rate", "copies", "copy", "shuffle_key"]
    want = sorted(duck.sql(queries.OP7_SQL).select(*columns).fetchall())
    assert sorted(tuple(r) for r in queries.op7_mixing(spark, corpus).select(*columns).collect()) == want


def test_large_means_are_poisson(spark):
    rows = [(i, "x" * 99, "few") for i in range(500)] + [(1000 + i, "x" * 99, "many") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, {"few": 99.0, "many": 1.0}, growth=40.4, keep=["doc_id", "source"], most_rate=None)
    copies = collections.Counter(r["doc_id"] for r in got.where("source = 'few'").collect())
    mean = 40.4 * 505 * 0.99 / 500
    found = [copies[i] for i in range(500)]
    average = sum(found) / 500
    spread = sum((x - average) ** 2 for x in found) / 499
    assert abs(average - mean) < 5 * (mean / 500) ** 0.5 and 0.75 < spread / mean < 1.25
