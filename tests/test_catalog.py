"""Every query of the catalogue against its SQL, on the smallest supplied tables."""

import os
from collections import Counter

import pytest

import __spark_entry__
from tokenloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    rel = duck.sql(catalog.SQL[name])
    assert got == rows(rel.columns, rel.fetchall())


def test_unigram_against_kernel(spark):
    from tokenloom import Tokenizer
    from tokenloom.plans import frozen

    t = Tokenizer(frozen.UNIGRAM)
    want = {r["doc_id"]: " ".join(map(str, t.encode(r["text"]))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["ids"] for r in catalog.QUERIES["unigram"](spark, SF).collect()} == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["lang", "n_docs", "n_tokens"] and df.count() == 4
    names = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
