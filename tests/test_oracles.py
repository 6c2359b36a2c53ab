"""Every registered query against its SQL twin (VOXLOOM_TEST_SF picks the scale)."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = f"/root/testdata/{os.environ.get('VOXLOOM_TEST_SF', 'sf0.001')}"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    problem = compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
