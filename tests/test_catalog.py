from __future__ import annotations

import pytest

import __spark_entry__
from tallyweave.plans import catalog, catalog_studies  # noqa: F401

from . import oracle
from .conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.compare(spark, con, SMALL, catalog.QUERIES[name], catalog.ORACLES[name]) > 0


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rules_fire_somewhere(spark):
    wide = catalog.QUERIES["repeated_wide"](spark, SMALL).filter("score > 0").count()
    assert wide > 0 and catalog.QUERIES["burst_events"](spark, SMALL).count() > 0
