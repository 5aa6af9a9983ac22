"""Every registered driver query against its DuckDB oracle on sf0.001
(row count, column names, order-insensitive value hash)."""

import pytest

import __spark_entry__ as ent
from souk.catalog import REGISTRY
from oracle.compare import _digest, _rows, duck_connection

SF = "/root/testdata/sf0.001"
QUERIES = {name: fn for name, fn in ent.queries().items() if name in REGISTRY}
SQLS = ent.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, SF).toPandas()
    assert name in SQLS
    dk = duck.execute(SQLS[name]).df()
    sc, sr = _rows(sp)
    dc, dr = _rows(dk)
    assert sc == dc
    assert len(sr) == len(dr)
    assert _digest(sr) == _digest(dr)


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() >= 0 and "platform_fee" in df.columns
