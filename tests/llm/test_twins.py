"""The registered queries of this folder against their SQL twins, and the pipeline."""

import pytest

from compare import compare, connect
from voxloom.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    problem = compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name])
    assert problem is None, problem
