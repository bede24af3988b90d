"""Every SQL-checked query equals its DuckDB oracle on the small fixture."""

import pytest

from demandflow.plans import ORACLE, QUERIES
from tests.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    problems = compare(df, con, ORACLE[name])
    assert not problems, problems
