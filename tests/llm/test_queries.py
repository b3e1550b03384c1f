import pytest
from oracle import SF_DIR, compare

from aerolytics.llm import queries


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_result_has_a_row_for_each_input_row(spark, name):
    rows = queries.QUERIES[name](spark, SF_DIR)
    if name.startswith("op1_"):
        assert "status" in rows.columns
    elif name.startswith("op13_"):
        assert rows.groupBy("item_id").count().where("count > 10").isEmpty()
    else:
        table = {"op7": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
        assert rows.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
