"""Every query against its SQL on the smallest tables."""

import compare
import pytest

from tessera.plans import cascade, formulas, requests, rules, sheets  # noqa: F401  add their queries
from tessera.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    compare.same(spark, name, QUERIES[name], ORACLE_SQL[name], SF, con)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
