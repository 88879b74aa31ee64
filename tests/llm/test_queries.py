"""Every registered query over the small tables: whole results, and SQL where there is some."""

import duckdb
import pytest

import __spark_entry__
from prosaic.llm import queries as llm
from tests.test_queries import TABLES, rows


def test_all_ten_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in llm.queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(llm.queries()) | {"pipeline"} <= names and set(llm.oracle_sql()) <= names


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, sf_dir, name):
    got = llm.queries()[name](spark, sf_dir).toPandas()
    source = spark.read.parquet(f"{sf_dir}/{'pages' if name.startswith('op9') else 'documents'}.parquet")
    key = "page_id" if name.startswith("op9") else "doc_id"
    assert set(got[key]) == {r[key] for r in source.select(key).collect()}
    if name in llm.oracle_sql():
        connection = duckdb.connect()
        for t in TABLES:
            connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = connection.sql(llm.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)
