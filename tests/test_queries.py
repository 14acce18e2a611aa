"""Every registered query of the library agrees with its SQL; the others run and are stable."""

from __future__ import annotations

import pytest
from conftest import SMALL, table_of

from palimpsest import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table_of(got) == table_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("ids", [[*range(10)], [0, 1, 3, 5, 6, 12, 20, 22, 23], [4, 5, 5, 9, 9, 9, 16, None, None, -1, 2], [8], []])
def test_cycle_components_of_incomplete_groups(spark, tmp_path, ids):
    import duckdb

    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["cycle_components"](spark, str(tmp_path))
    assert got.dtypes == [("component", "string"), ("members", "string")]
    assert table_of(got.toPandas()) == table_of(c.sql(catalog.ORACLE_SQL["cycle_components"]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["query_id", "vec_id"]
