"""Every registered query against its SQL, on the given tables."""

import os

import pytest

from catalog.oracles import oracles
from catalog.queries import queries
from tests.compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) == set(oracles())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    assert difference(name, queries()[name](spark, FOLDER), duck, oracles()[name]) is None
