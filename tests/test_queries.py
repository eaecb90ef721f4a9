"""Every registered query against its SQL, and against the conventions all of them share."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from logweir.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir) == ""


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"event_date", "level", "events", "redacted"}
