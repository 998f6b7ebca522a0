"""Every registered venue query against its SQL over the same tables."""

import decimal
import math

import duckdb
import pytest

from atrium.plans import fixtures, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in fixtures.BASE:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value) if not isinstance(value, decimal.Decimal) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    relation = duck.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
    assert got, "no rows"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(fixtures.FIXTURES))
def test_derived_tables_agree(spark, duck, name):
    got = sorted(str(tuple(map(plain, r))) for r in fixtures.fixture(spark, FOLDER, name).collect())
    assert got == sorted(str(tuple(map(plain, r))) for r in duck.sql(fixtures.oracle(f"select * from {name}")).fetchall())


def test_entry_points_import_without_the_corpus_package():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
