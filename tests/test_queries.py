import pytest
from oracle import assert_same, connect

from terrace import catalog
from terrace.plans.listings import listings


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, connection, name):
    assert_same(spark, connection, sf_dir, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name, key, table, column", [("export_order_all", "id", None, "id"), ("crm_payload_all", "id", None, "id"), ("price_verification_all", "id", "part", "p_partkey")])
def test_every_row_is_there(spark, sf_dir, name, key, table, column):
    all_rows = spark.read.parquet(f"{sf_dir}/{table}.parquet") if table else listings(spark, sf_dir)
    assert sorted(r[0] for r in catalog.QUERIES[name](spark, sf_dir).select(key).collect()) == sorted(r[0] for r in all_rows.select(column).collect())


def test_every_listing_that_can_be_compared_has_a_tier(spark, sf_dir):
    can = listings(spark, sf_dir).where("product IN ('Land', 'House & Land', 'Apartment') AND suburb IS NOT NULL AND bedrooms IS NOT NULL")
    assert sorted(r.id for r in catalog.QUERIES["ladder_tier_all"](spark, sf_dir).collect()) == sorted(r.id for r in can.select("id").collect())
