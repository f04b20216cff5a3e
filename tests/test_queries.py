"""Every registered query against its SQL oracle, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check
from tallyline.plans.oracles import ORACLES
from tallyline.plans.queries import QUERIES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["l_orderkey", "sum"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    found = check.spark_rows(QUERIES[name](spark, sf_dir))
    assert found == check.oracle_rows(sf_dir, ORACLES[name])
