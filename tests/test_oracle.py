"""DuckDB oracles through __spark_entry__ at sf0.01 (one query per group;
``tools/oracle_check.py`` runs all of them)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF01
from tools.oracle_check import TABLES, rows

SUBSET = [
    "non_blank", "label_except", "split_70_15_15", "confusion_wide", "classification_report",
    "verification_sample", "vocabulary_topk", "tfidf_transform", "encode_fixed_length", "softmax",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF01}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF01).toPandas()
    want = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)
