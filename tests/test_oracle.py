"""Tier 2: every registered query against its DuckDB oracle text on the driver tables."""

import duckdb
import pytest

import __spark_entry__ as E
from fleetlens.plans.catalog import REGISTRY
from fleetlens.plans.compare import compare, type_problems
from fleetlens.sources.fixtures import TABLES

from .conftest import SF001

# The library's own queries; the optional subpackages test theirs themselves.
QUERIES = {k: E.queries()[k] for k in REGISTRY}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in REGISTRY}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF001)
    rows = df.collect()
    res = con.execute(ORACLE[key])
    dcols = [d[0] for d in res.description]
    problems = compare(df.columns, rows, dcols, res.fetchall()) + type_problems(df, con, ORACLE[key])
    assert not problems, problems


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["uid", "username", "group_name"]
