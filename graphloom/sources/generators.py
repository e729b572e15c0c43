"""Synthetic graphs by rule: (src, dst) rows made from a range of vertices, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph

_STRIDE = 7919
#: Sources of a band, and edges of a task at most, of cliques: its destinations (65,536) stay within a dictionary of a Parquet column.
_BAND, _TASK = 256, 1 << 24


def _graph(spark: SparkSession, n: int, targets: str) -> Graph:
    v = spark.range(n).withColumnRenamed("id", "vid")
    return Graph(v, v.select(F.col("vid").alias("src"), F.explode(F.expr(targets)).alias("dst")))


def random_graph(spark: SparkSession, n: int, most: int, seed: int = 1) -> Graph:
    """1 to `most` different neighbours of each vertex, never itself: steps of a stride that shares no factor with n - 1."""
    stride = _STRIDE if (n - 1) % _STRIDE else 1
    count = f"least(1 + (vid * 104729 + {seed}) % 1000003 % {most}, {n - 1})"
    return _graph(spark, n, f"transform(sequence(1L, {count}), j -> (vid + 1 + ((vid * 7907 + {seed}) % 1000003 + j * {stride}) % {n - 1}) % {n})")


def chain(spark: SparkSession, n: int) -> Graph:
    """Each vertex with the one before it and the one after it."""
    return segments(spark, n, 1)


def segments(spark: SparkSession, n: int, parts: int) -> Graph:
    """Equal chains without edges between them; n is rounded down to a multiple of `parts`."""
    size = n // parts
    return _graph(spark, size * parts, f"filter(array(vid - 1, vid + 1), x -> x >= 0 AND x < {size * parts} AND x div {size} = vid div {size})")


def cliques(spark: SparkSession, n: int, parts: int) -> Graph:
    """Equal groups in which every vertex has an edge to every other one. There are n * (n / parts - 1) edges, so they come from a range of
    their own, in even tasks and without lists of neighbours. A band of sources meets one destination after another: columns of files
    take such runs in about one bit an edge, where a list of all destinations after each source takes 14 and more."""
    size = n // parts
    edges, group, band = parts * size * (size - 1), max(size * (size - 1), 1), max(_BAND * (size - 1), 1)
    e = spark.range(0, edges, 1, max(spark.sparkContext.defaultParallelism, -(-edges // _TASK)))
    e = e.selectExpr(f"id div {group} * {size} AS low", f"id % {group} div {band} * {_BAND} AS first", f"id % {group} % {band} AS at")
    e = e.selectExpr("low", f"first + at % least({_BAND}, {size} - first) AS i", f"at div least({_BAND}, {size} - first) AS j")
    # j counts the others of a vertex, so it steps over the vertex itself
    return Graph(spark.range(size * parts).withColumnRenamed("id", "vid"), e.selectExpr("low + i AS src", "low + if(j < i, j, j + 1) AS dst"))
