"""Every registered query against its reference SQL on the smallest tables."""

import pytest

from workload.all import ORACLES, QUERIES
from workload.check import compare, duck_connection
from workload.views import Views

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_DIR)


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    from mailloom.session import ship_package

    ship_package(spark)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, rows = compare(QUERIES[name](Views(spark, SF_DIR)), con, ORACLES[name])
    assert not problem, problem
    assert rows > 0
