import pytest
from tests.compare import same, views
from tests.conftest import DATA

import __spark_entry__
from clademill import catalogue
from clademill.operators import segments


@pytest.fixture(scope="module")
def con():
    return views(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert not same(catalogue.QUERIES[name](spark, DATA), con, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_components_of_all_edges(spark):
    edges = [(r.l_suppkey, r.l_partkey + 1000000) for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        one, two = sorted((find(a), find(b)))
        parent[two] = one
    assert {r.node: r.component for r in catalogue.QUERIES["graph_components"](spark, DATA).collect()} == {x: find(x) for x in parent}


def test_best_segments_of_a_strong_segment_pass_a_corrected_threshold(spark):
    rows = [("a", k, 5.0 if 40 <= k < 60 else float(k % 2) / 10) for k in range(200)]
    assert segments.best_segments(spark.createDataFrame(rows, "k string, at long, x double"), "k", "at", "x").first().p == 1 / 2001
