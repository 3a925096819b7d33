"""Every registered query against its SQL twin on the smallest generated tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from parcelflow.plans.oracle import ORACLE
from parcelflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="generated tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_twin():
    """Every query of the delivery engine; training-data queries say themselves which have one."""
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.items() <= entry.queries().items() and ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLE[name], SF) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6
