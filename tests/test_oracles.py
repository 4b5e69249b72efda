"""Every registered query against its SQL on the smallest tables."""

import pytest

import oracle
from changelens.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], SF) is None
