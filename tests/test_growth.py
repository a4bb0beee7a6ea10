"""Findings of growth: each of these would have failed, or not ended, before."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.compare import same, views

from clademill import catalogue
from clademill.operators import graph
from clademill.operators import joins as J


@pytest.fixture
def tables(spark, tmp_path):
    def write(**frames):
        for name, df in frames.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/all/{name}")
            part = next((tmp_path / "all" / name).glob("*.parquet"))
            part.rename(tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


def test_kmer_jaccard_is_linear_in_the_length_of_a_text(spark, tables):
    texts = [("abc\ndé𝄞f" * 100000)[k : 800000 - 7 * k] for k in range(2)]
    sets = [{x[k : k + 12] for k in range(0, len(x) - 11, 3)} for x in texts]
    began = time.time()
    found = catalogue.QUERIES["kmer_jaccard"](spark, tables(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert [(r.doc_id, r.jaccard) for r in found] == [(0, round(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), 6))]
    assert time.time() - began < 30  # a place counted from the start of the text takes minutes


def test_kmer_jaccard_of_odd_texts(spark, tables):
    texts = [None, "", "abcdefghijk", "abcdefghijkl", "abcdefghijklm𝄞o", "𝄞" * 15, "𝄞" * 12 + "\n\r " * 9, "\n" * 40, "ab\n" * 9, "ab\n" * 8 + "c"]
    path = tables(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert not same(catalogue.QUERIES["kmer_jaccard"](spark, path), views(path), catalogue.ORACLE_SQL["kmer_jaccard"])


def test_range_join_makes_rows_that_files_keep_small(spark, tmp_path):
    points = spark.range(40000).selectExpr("id * 7919 % 1000003 as point", "id * 31 % 100 as day", "if(id % 9 = 0, null, id) as other")
    spans = spark.range(300).selectExpr("id as span", "id % 70 as s", "id % 70 + 29 as e")
    J.range_join(points, spans, "day", "s", "e", 64).select("point", "span").write.parquet(f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == 400 * 30 * 300 and found.exceptAll(points.join(spans, F.expr("day between s and e")).select("point", "span")).isEmpty()
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 1000000


def test_range_join_keeps_every_column_and_row(spark):
    points = spark.createDataFrame([(1, None, "a"), (2, -3, None), (3, 5, "c"), (3, 5, "c"), (4, 70, "d"), (5, 71, "e")], "point long, day long, other string")
    spans = spark.createDataFrame([(1, -3, 70), (2, 5, 5), (3, 6, 4), (4, None, 9), (2, 5, 5)], "span long, s long, e long")
    found = J.range_join(points, spans, "day", "s", "e", 8)
    assert found.columns == ["point", "day", "other", "span", "s", "e"]
    assert sorted(found.collect(), key=repr) == sorted(points.join(spans, F.expr("day between s and e")).collect(), key=repr)
    assert J.range_join(points.select("day"), spans, "day", "s", "e", 8).count() == found.count()


def test_nearest_writes_each_vector_once_and_breaks_ties_by_id(spark, monkeypatch):
    """Twelve blocks, among them many equal vectors, zeros, equal ids and values that single precision can't tell apart."""
    monkeypatch.setattr(J, "BLOCK", 100)
    monkeypatch.setattr(J, "SHARE", 1 << 15)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x[:300] = x[0]
    x[300:310] = 0
    x[310:700] = x[310] + rng.normal(size=(390, 16)) * 1e-5
    ids = rng.permutation(5000)[:1200]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = np.round(unit @ unit.T, 9)
    want = {}
    for k in range(len(ids)):
        order = np.lexsort((ids, -near[k]))
        want[int(ids[k])] = [(int(ids[m]), near[k, m]) for m in order if m != k][:5]
    vectors = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, x, strict=True)], "id long, v array<double>")
    found = J.nearest(vectors, "id", "v", 5)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query, []).append((r.match, r.cosine))
    close = [(a, b) for k in want for a, b in zip(want[k], got[k], strict=True)]
    assert len(got) == 1200 and all(abs(a[1] - b[1]) < 2e-9 for a, b in close)
    assert sum(a[0] != b[0] for a, b in close) <= 5  # a value halfway between two of nine places
    assert "explode" not in found._jdf.queryExecution().toString().lower()
    assert J.nearest(vectors.limit(0), "id", "v", 5).count() == 0 and J.nearest(vectors.limit(1), "id", "v", 5).count() == 0 and J.nearest(vectors.limit(4), "id", "v", 5).count() == 12


def test_components_of_one_large_component_and_a_hub_go_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 300)
    edges = [(0, k) for k in range(1, 2500)] + [(k, k + 1) for k in range(5000, 5400)] + [(9000 + k % 7, 9000 + k % 11) for k in range(80)] + [(9999, 9999), (5400, 5000)]
    df = spark.createDataFrame(edges * 2, "a long, b long")
    found = {r.node: r.component for r in graph.components(df, "a", "b").collect()}
    assert found == {**dict.fromkeys([0, *range(1, 2500)], 0), **dict.fromkeys(range(5000, 5401), 5000), **dict.fromkeys(range(9000, 9011), 9000)}
    rows = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    known = spark.range(10000).selectExpr("id as u", "id + 1 as l")
    monkeypatch.setattr(graph, "ROWS", 1000)
    out = graph._looked_up(rows, known, "u", 16)
    assert out.exceptAll(rows.join(known, "u")).isEmpty() and out.count() == rows.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = graph._looked_up(rows, known, "u", 16).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert most < 2600  # the hub's 4,998 rows are not in one task
