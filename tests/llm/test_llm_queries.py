"""The registered queries on the smallest tables: all there, whole, and equal to SQL where there is SQL."""

import duckdb
import pytest

from maskwright.llm import queries

SF = "/root/testdata/sf0.001"


def test_ten_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ours, theirs = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    values = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).values))
    assert values(ours) == values(theirs) and len(ours) > 0


@pytest.mark.parametrize("name", [k for k in queries.queries() if not k.startswith(("op5", "op6"))])
def test_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    found = queries.queries()[name](spark, SF).select("doc_id")
    assert found.exceptAll(docs).count() == docs.exceptAll(found).count() == 0
