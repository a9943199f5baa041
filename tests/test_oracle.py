"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracle import compare, duck

from tarnlake.plans import REGISTRY


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, sf_dir, name):
    ok, message, _ = compare(spark, con, name, REGISTRY[name], sf_dir)
    assert ok, message
