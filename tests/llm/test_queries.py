"""Registered queries against their SQL in DuckDB, and fixed columns of the others."""

import zlib

import pytest

import __spark_entry__ as entry_module
from tablelab.llm import queries as corpus
from tests import sql_check


@pytest.fixture(scope="module")
def duck(folder):
    return sql_check.connect(folder)


def test_registered():
    assert set(corpus.QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in corpus.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(corpus.SQL))
def test_same_as_sql(spark, duck, folder, name):
    status, _, _, note = sql_check.compare(spark, duck, folder, name)
    assert status == "ok" and not note, note


@pytest.mark.parametrize("name, folds, held", [("op1_toxicity", 3, 1), ("op8_pairwise_quality", 5, 0)])
def test_scores(spark, folder, name, folds, held):
    rows = corpus.QUERIES[name](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cut = {"op1_toxicity": 0.7, "op8_pairwise_quality": 0.3}[name]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
