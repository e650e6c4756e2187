"""Every registered query against its SQL statement on the smallest tables."""

import os

import pytest
from check import connect, differences

import __spark_entry__ as entry
from gleanspark.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_statements_belong_to_queries():
    assert set(ORACLES) <= set(NAMES)
    assert len(NAMES) > 130


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    frame = entry.queries()[name](spark, SF_DIR)
    statement = entry.oracle_sql().get(name)
    if statement is None:
        assert frame.count() > 0
    else:
        assert differences(frame, con, statement) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 40
