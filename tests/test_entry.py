"""The driver's contract, and every own query against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from slips import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "receipt_type" in df.columns
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def rows(names, found):
    return sorted(repr(tuple(r[k] for k in sorted(names))) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    cursor = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(names, got.collect()) == rows(names, [dict(zip(names, r, strict=True)) for r in cursor.fetchall()])
