"""Catalogue queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from catalog.oracle import ORACLE
from catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "documents", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()


@pytest.mark.parametrize(
    "name",
    [
        "find_date_valid",
        "resolved_stored_spans",
        "mask_date_month",
        "gold_from_inline_tags",
        "bio_runs",
        "annotation_mask",
        "scores_partial_gold",
        "scores_compare",
        "unpaired_documents",
        "deidentify_with_models_all",
        "annotate_models",
        "deidentify_with_models",
        "scores_document",
    ],
)
def test_query_matches_sql(spark, oracle, name):
    got = entry_points.queries()[name](spark, SF_DIR)
    want = oracle.execute(entry_points.oracle_sql()[name])
    columns = sorted(got.columns)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted(tuple(r[i] for i in order) for r in want.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == expected


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["doc_id", "masked_text", "n_spans"]
