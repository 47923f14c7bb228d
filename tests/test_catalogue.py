import pytest

from sitefold.plans import catalogue

from .oracle import assert_same

SF = "/root/testdata/sf0.001"
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    assert_same(Q[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert Q[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, tmp_path):
    from sitefold.operators import overview as O

    path = str(tmp_path / "log")
    spark.createDataFrame([("a", "b", 0, "u", "200", "2024-01-01", "", ""), ("a", "b", 0, "u", "500", "2024-01-02", "", "")], O.SCHEMA).write.partitionBy("session_date").parquet(path)
    plan = O.success_window(spark.read.schema(O.SCHEMA).parquet(path), "2024-01-01", "2024-01-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(session_date" in plan and "EqualTo(status,200)" in plan
