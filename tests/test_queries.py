import pytest

from helpers import DATA, duck, rows
from partgraph.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, name):
    assert rows(QUERIES[name](spark, f"{DATA}/sf0.001")) == duck("sf0.001", ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "label"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_lineitem(spark):
    lines = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet")
    pairs = lines.select("l_orderkey", "l_partkey").distinct().count()
    assert QUERIES["rich_edges"](spark, f"{DATA}/sf0.001").count() == pairs
    assert not [name for name in QUERIES if "l_quantity >=" in ORACLE_SQL.get(name, "")]
