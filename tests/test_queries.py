"""Every query that has SQL gives the rows of its SQL, on the smallest tables."""

import os

import pytest
from oracle import both

from webquarry.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    found, wanted = both(spark, FOLDER, QUERIES[name], ORACLES[name])
    assert found == wanted


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 1
