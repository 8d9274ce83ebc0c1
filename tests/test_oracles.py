"""Every query with an oracle gives the oracle's rows, on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from oracle_check import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
