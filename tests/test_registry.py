"""Every registered query against its SQL, and the shape of the three entry points."""

import pytest

import __spark_entry__ as entry_points
import oracle

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_is_stable(spark, sf_dir, name):
    once = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()), key=str)
    again = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()), key=str)
    assert once and once == again


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    row = entry_points.entry(spark).first()
    assert row["queries"] > 0 and 0 <= row["ndcg_at_10"] <= 1
