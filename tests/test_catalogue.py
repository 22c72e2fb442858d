"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from kgloom.plans import applying, catalogue, files, further  # noqa: F401 - register their queries

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship_values(spark):
    r = catalogue.flagship(spark, DATA).first()
    assert (r.golds, round(r.mrr, 9), round(r.h1, 9), r.h10) == (497, 0.365940736, 0.140845070, 1.0)


@pytest.mark.parametrize("name", ["fit_linear_relation", "fit_surprisal_relation"])
def test_fit_lowers_the_loss(spark, name):
    found = catalogue.QUERIES[name](spark, DATA).collect()
    assert found and all(r.last_loss < r.first_loss and r.trained >= 0 for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_graph_queries_over_all_relations(spark):
    projected = {r.p: r.n for r in catalogue.QUERIES["kg_projection_counts"](spark, DATA).collect()}
    encoded = {r.p: r.n for r in catalogue.QUERIES["kg_encode_all"](spark, DATA).groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert encoded == dict(enumerate(projected[p] for p in sorted(projected))) and len(encoded) == 10
