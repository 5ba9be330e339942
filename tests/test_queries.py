import pytest
from compare import duck, sparked

from siltstone import queries

FAST = [n for n in queries.QUERIES if n not in queries.storage_queries.QUERIES]


@pytest.mark.parametrize("name", [n for n in FAST if n in queries.ORACLES])
def test_equals_duckdb(spark, sf, name):
    assert sparked(queries.QUERIES[name](spark, sf)) == duck(sf, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.storage_queries.QUERIES))
def test_through_the_store(spark, sf, name):
    assert sparked(queries.QUERIES[name](spark, sf)) == duck(sf, queries.ORACLES[name])


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = queries.QUERIES["filter_body_eq"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "user_id" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["filter_time_bound", "filter_and", "newest_top_n_filtered"])
def test_times_reach_the_scan(spark, sf, name):
    pushed = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert "GreaterThanOrEqual(ts," in pushed or "LessThan(ts," in pushed


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
