"""Every query with an oracle against DuckDB on the smallest tables, and invariants of the others."""

import os

import duckdb
import pytest

import __spark_entry__
from qaspark.registry import ORACLE_SQL, QUERIES
from qaspark.sources.adapters import BASE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    ran = duck.execute(ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in ran.description], ran.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
