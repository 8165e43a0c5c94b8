import pytest

from pointloom.llm import oracles, queries
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, queries.queries()[name], oracles.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_whole_tables(spark, name):
    """A row for each document (a piece or a match of several), each query or each conversation."""
    got = queries.queries()[name](spark, SF)
    if name.startswith("op5_"):
        ids = got.select("query_id").distinct().count()
        assert ids == spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    elif not name.startswith("op6_"):
        assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_entry_lists_all():
    import __spark_entry__ as e

    assert [n for n in e.queries() if n.startswith("op")] == list(queries.queries()) and "pipeline" in e.queries()
