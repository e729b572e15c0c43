"""Connected components of a link table, in a number of rounds that grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialise


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _lowest(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large(e: DataFrame, edges: int) -> DataFrame:
    """Every neighbour above u is tied to the smallest neighbour of u."""
    s = _both(e)
    low = _lowest(s).withColumn("m", F.least("m", "u"))
    return join_by_key(s, low, "u", 2 * edges).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame, edges: int | None = None) -> DataFrame:
    """Edges point down; u and its lower neighbours are tied to the smallest of them. A u with very many lower neighbours is only
    dealt out where the number of edges is given: once they are tied to one, few are left."""
    d = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = _lowest(d)
    found = d.join(low, "u") if edges is None else join_by_key(d, low, "u", edges)
    tied = found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(low.select("u", F.col("m").alias("v")))


def _stars(e: DataFrame) -> bool:
    """Whether each id has one edge down at most, and none that also has one up: one sum by id tells, without a further round."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    held = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not held.filter("down > 1 or down > 0 and up > 0").agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (id, component): every linked id with the smallest id that it reaches. Self links, repeats and
    nulls are ignored; no links give an empty table. Read from a written table of stars, each around its smallest id."""
    e = links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    e = materialise(_small(e, e.count()).distinct(), "cc")
    while not _stars(e):
        e = materialise(_small(_large(e, e.count()).distinct()).distinct(), "cc")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
