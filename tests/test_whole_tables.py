"""Queries of whole vectors, and whole tables sorted and reversed."""

import pytest
from test_relations import DATA, duck, same  # noqa: F401

from treeloom import catalog


@pytest.mark.parametrize("name", ["q_explode_whole", "q_flatten_whole", "q_sort_multi_whole", "q_sort_scalars_whole", "q_reverse_whole"])
def test_whole(spark, duck, name):  # noqa: F811
    same(catalog.run(name, spark, DATA), duck, catalog.Q[name][1])


def test_nothing_is_cut(spark):
    rows = lambda table: spark.read.parquet(f"{DATA}/{table}.parquet")
    values = rows("embeddings").selectExpr("sum(size(embedding))").first()[0]
    assert catalog.run("q_explode_whole", spark, DATA).count() == catalog.run("q_flatten_whole", spark, DATA).count() == values
    for name, table in (("q_sort_multi_whole", "part"), ("q_sort_scalars_whole", "customer"), ("q_reverse_whole", "events")):
        assert catalog.run(name, spark, DATA).count() == rows(table).count()
