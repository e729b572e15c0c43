"""A graph over the driver's tables: vertices are embeddings, edges come from orders, and a second, weighted graph from lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nn import batch_statistics
from ..operators.graph import Graph

WIDTH = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, h, label, mask)"""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("vid"), F.col("embedding").cast("array<double>").alias("h"), F.col("label").cast("long").alias("label"), (F.col("vec_id") % 3).cast("int").alias("mask"))


def plain_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Distinct (customer, order) pairs, modulo the number of vertices; loops only where they fall."""
    v = vertices(spark, sf_dir).select("vid")
    n = F.lit(v.count())
    e = read(spark, sf_dir, "orders").select((F.col("o_custkey") % n).alias("src"), (F.col("o_orderkey") % n).alias("dst")).distinct()
    return Graph(v, e)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The plain graph with one loop per vertex."""
    return plain_graph(spark, sf_dir).with_self_loops()


def star(spark: SparkSession, sf_dir: str) -> Graph:
    """Two hubs in one vertex: all orders lead to vertex 0, which leads to all customers; with one loop per vertex."""
    v = vertices(spark, sf_dir).select("vid")
    n, o, zero = F.lit(v.count()), read(spark, sf_dir, "orders"), F.lit(0).cast("long")
    e = o.select((F.col("o_orderkey") % n).alias("src"), zero.alias("dst")).union(o.select(zero, F.col("o_custkey") % n))
    return Graph(v, e.distinct()).with_self_loops()


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): quantity from each supplier to each part; parts are numbered after suppliers."""
    n = read(spark, sf_dir, "supplier").count()
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + n).alias("dst")).agg(F.sum("l_quantity").alias("w"))


def random_source(spark: SparkSession, n: int, width: int, classes: int, seed: int = 7) -> DataFrame:
    """(vid, h, label, mask): features 1, hashed labels, masks in turn."""
    v = spark.range(n).withColumnRenamed("id", "vid")
    return v.select("vid", F.array_repeat(F.lit(1.0), width).alias("h"), ((F.col("vid") * 7919 + seed) % 1000003 % classes).alias("label"), (F.col("vid") % 3).cast("int").alias("mask"))


def split_by_rank(ids: DataFrame, sizes: tuple[int, int, int] = (100, 100, 100)) -> DataFrame:
    """(vid, part): the first ids train, the next validate, the next test."""
    a, b, c = sizes
    part = F.when(F.col("vid") < a, "train").when(F.col("vid") < a + b, "val").when(F.col("vid") < a + b + c, "test").otherwise("unknown")
    return ids.select("vid", part.alias("part"))


def standardize(v: DataFrame, width: int = WIDTH, train: Column | None = None) -> DataFrame:
    """Features scaled by mean and deviation of the training rows; a deviation of 0 counts as 1."""
    t = v.filter(F.col("mask") == 0 if train is None else train)
    stats = batch_statistics(t, width).withColumn("sd", F.transform("va", F.sqrt)).drop("va")
    z = F.transform(F.arrays_zip("h", "mu", "sd"), lambda a: (a.h - a.mu) / F.when(a.sd == 0, 1.0).otherwise(a.sd))
    return v.join(F.broadcast(stats)).withColumn("h", z).drop("mu", "sd")


def removed_edges(g: Graph, v: DataFrame) -> DataFrame:
    """(src, dst, removed): whether an edge touches a vertex outside of the training mask."""
    out = v.select("vid", (F.col("mask") != 0).alias("out"))
    e = g.edges.join(out.select(F.col("vid").alias("src"), F.col("out").alias("a")), "src").join(out.select(F.col("vid").alias("dst"), F.col("out").alias("b")), "dst")
    return e.select("src", "dst", (F.col("a") | F.col("b")).alias("removed"))
