import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators import graph


def _graph(spark):
    nodes = spark.createDataFrame([(x,) for x in ["a", "a", "a", "b", "c", None, None]], "id string")
    edges = [("a", "b"), ("a", "b"), ("a", "x"), ("a", "x"), ("y", "b"), ("y", "z"), (None, "a"), ("b", None), ("c", "c"), (None, None), (None, None)]
    return nodes, spark.createDataFrame(edges, "source string, target string")


def test_integrity_of_an_odd_graph(spark):
    nodes, edges = _graph(spark)
    assert graph.integrity(nodes, edges).collect() == [(3, 3, 8)]
    assert graph.integrity(nodes.limit(0), edges.limit(0)).collect() == [(0, 0, 0)]


def test_nothing_is_counted_before_rows_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 10)
    nodes = spark.range(64).select(F.col("id").cast("string").alias("id"))
    assert graph._parts(nodes) == 7 and graph._parts(nodes.limit(0)) == 4
    nodes, edges = _graph(spark)
    assert graph.integrity(nodes, edges).collect() == [(3, 3, 8)]


def test_contracted_edges_are_in_the_order_of_bytes(spark):
    edges = spark.createDataFrame([("z", "é"), ("é", "😀"), ("￿", "😀"), ("q", "r")], "a string, b string").coalesce(1)
    got = graph.contracted(edges).collect()
    assert sorted(got) == sorted([("é", "z"), ("￿", "z"), ("😀", "z"), ("r", "q")]) and pa.array(["￿", "😀"]).sort().to_pylist() == ["￿", "😀"]
