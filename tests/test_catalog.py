import pytest
from oracle import rows_of, sql_rows

from keystrata import catalog, service_catalog
from keystrata.catalog import flagship

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES | service_catalog.QUERIES, catalog.ORACLES | service_catalog.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == sql_rows(SF, ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_filter_on_key_reaches_the_scan(spark, tmp_path):
    from keystrata.operators import visibility

    spark.createDataFrame([(1, "a", 1, "x")], "seq long, key string, op int, value string").write.mode("overwrite").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = visibility.scan_from(log, "a")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "EqualTo(op" not in plan.split("PushedFilters")[1].split("]")[0]
