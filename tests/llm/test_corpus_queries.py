"""The registered corpus queries: SQL where there is some, and the pipeline as a whole."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skylattice.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.sql(queries.ORACLES[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in expected.fetchall())


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).persist()
        counts.append(docs.count())
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)
        assert (len(docs.columns) == 5) == (k + 1 < len(corpus_pipeline.STAGES))
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] <= counts[2] and counts[4] < counts[3] and 0 < counts[5] < counts[4]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_near_duplicates_of_a_repeated_id(spark):
    """A text that copies another goes alone, not with the other texts of its id; of equal rows one stays."""
    copied, own = (" ".join(f"{w}{i}" for i in range(80)) for w in "ab")
    rows = [(1, copied, "en", "s", 1), (2, copied, "en", "s", 1), (2, own, "en", "s", 2), (3, "c", "en", "s", 3), (3, "c", "en", "s", 3),
            (None, copied, "en", "s", 1), (None, copied, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, copied), (2, own), (3, "c"), (None, copied), (None, copied)], key=str)
