"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest
from conftest import SMALL
from oracle_check import compare, duck

from itemspark.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    message, _ = compare(spark, con, name, SMALL)
    assert message is None, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
