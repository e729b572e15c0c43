"""A partitioner that keeps edges within parts: size-bounded label propagation over a coarsened graph, level by level.

1. Coarsening: each vertex names its heaviest neighbour (ties by hash) with which it stays below a size; two that name each other become
   one, and their edges are added up. This is repeated until few clusters are left or none merges.
2. The coarsest clusters are dealt out to parts in ranges of equal size, in the order of a hash.
3. Refinement, from the coarsest level to the vertices: in a round, a half of the vertices (by hash) looks for the part to which it has
   most edges. Gains are counted by part, gain and bucket of a hash, and moves are let in from the largest gain on while they fit
   below the part's limit, balance times the mean. So no part ever passes its limit, whatever leaves.

All steps are joins and aggregations that combine on the map side; sums that decide run over counts by bucket, never over vertices, and nothing
comes to the driver but numbers of rows. The result depends on the graph only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, discard
from .graph import Graph
from .vectors import running_sum

#: Buckets of a gain, of which each moves as a whole or stays.
BUCKETS = 256
#: Clusters per part at which coarsening ends, and the share of a part that a cluster may reach.
CLUSTERS, LARGEST = 32, 0.05
LEVELS, ROUNDS = 8, 4


def both_ways(graph: Graph) -> DataFrame:
    """(u, v, w): how many edges lead from u to v or back, in both directions; without loops."""
    e = graph.without_self_loops().edges
    pairs = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    return pairs.groupBy("u", "v").agg(F.count("*").alias("w"))


def _matched(w: DataFrame, sizes: DataFrame, most: float, level: int) -> DataFrame:
    """(vid, into): each vertex with the cluster that it is part of from now on."""
    size = lambda end: sizes.select(F.col("vid").alias(end), F.col("size").alias(f"s{end}"))
    fits = w.join(size("u"), "u").join(size("v"), "v").filter(F.col("su") + F.col("sv") <= most)
    # both ends see the same rank of their edge
    rank = F.struct("w", F.xxhash64(F.least("u", "v"), F.greatest("u", "v"), F.lit(level)).alias("h"), "v")
    named = fits.groupBy("u").agg(F.max(rank).alias("best")).select("u", F.col("best.v").alias("v"))
    mutual = named.join(named.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"])
    return sizes.select("vid").join(mutual.select(F.col("u").alias("vid"), "v"), "vid", "left").select("vid", F.least("vid", F.coalesce("v", "vid")).alias("into"))


def _contracted(w: DataFrame, sizes: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    name = lambda end: into.select(F.col("vid").alias(end), F.col("into").alias(f"to_{end}"))
    edges = w.join(name("u"), "u").join(name("v"), "v").filter("to_u <> to_v").groupBy(F.col("to_u").alias("u"), F.col("to_v").alias("v")).agg(F.sum("w").alias("w"))
    return edges, sizes.join(into, "vid").groupBy(F.col("into").alias("vid")).agg(F.sum("size").alias("size"))


def _refined(w: DataFrame, labels: DataFrame, limit: float, salt: int) -> DataFrame:
    """One round over labels(vid, size, part)."""
    toward = w.join(labels.select(F.col("vid").alias("v"), "part"), "v").groupBy(F.col("u").alias("vid"), F.col("part").alias("to")).agg(F.sum("w").alias("w"))
    half = labels.filter(F.pmod(F.xxhash64("vid", F.lit(salt)), F.lit(2)) == 0)
    best = F.max(F.when(F.col("to") != F.col("part"), F.struct("w", F.xxhash64("vid", "to").alias("h"), "to"))).alias("best")
    inside = F.coalesce(F.max(F.when(F.col("to") == F.col("part"), F.col("w"))), F.lit(0)).alias("inside")
    moves = toward.join(half, "vid").groupBy("vid", "size", "part").agg(best, inside)
    moves = moves.select("vid", "size", F.col("best.to").alias("to"), (F.col("best.w") - F.col("inside")).alias("gain")).filter("gain > 0")
    moves = moves.withColumn("bucket", F.pmod(F.xxhash64("vid", F.lit(salt + 1)), F.lit(BUCKETS)))
    room = labels.groupBy(F.col("part").alias("to")).agg((F.lit(limit) - F.sum("size")).alias("room"))
    asked = moves.groupBy("to", "gain", "bucket").agg(F.sum("size").alias("size"))
    held = F.sum("size").over(Window.partitionBy("to").orderBy(F.desc("gain"), "bucket"))
    let_in = asked.withColumn("held", held).join(room, "to").filter("held <= room").select("to", "gain", "bucket")
    moved = moves.join(let_in, ["to", "gain", "bucket"]).select("vid", "to")
    return labels.join(moved, "vid", "left").select("vid", "size", F.coalesce("to", "part").alias("part"))


def partition(graph: Graph, parts: int, balance: float = 1.1, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """(vid, part): parts from 0, none with more than balance times the mean number of vertices."""
    spark, held = graph.vertices.sparkSession, []
    keep = lambda df: cut(df, "parts", held)
    total = graph.vertices.count()
    mean = total / parts
    if int(balance * mean) * parts < total:
        raise ValueError(f"{total} vertices don't fit {parts} parts of at most {balance} times the mean")
    # the room above the mean must hold a cluster, so that ranges of whole clusters stay below the limit
    most, limit = max(1.0, min(LARGEST, balance - 1) * mean), max(balance * mean, -(-total // parts))
    w, sizes, trail = keep(both_ways(graph)), keep(graph.vertices.select("vid", F.lit(1).cast("long").alias("size"))), []
    count = total
    for level in range(levels):
        if count <= CLUSTERS * parts:
            break
        into = keep(_matched(w, sizes, most, level))
        coarse = tuple(map(keep, _contracted(w, sizes, into)))
        now = coarse[1].count()
        if now > 0.95 * count:
            break
        trail.append((w, sizes, into))
        (w, sizes), count = coarse, now
    # whole clusters in the order of a hash; one belongs to the part in which it begins
    dealt = running_sum(sizes.withColumn("place", F.pmod(F.xxhash64("vid"), F.lit(1 << 40))).withColumn("key", F.col("place") * F.lit(1 << 10) + F.pmod("vid", F.lit(1 << 10))), "key", "size", "before", 1 << 44)
    labels = keep(dealt.select("vid", "size", F.least(F.floor(F.col("before") / F.lit(mean)), F.lit(parts - 1)).cast("int").alias("part")))
    for depth in range(len(trail), -1, -1):
        if depth < len(trail):
            w, sizes, into = trail[depth]
            labels = keep(sizes.join(into, "vid").join(labels.select(F.col("vid").alias("into"), "part"), "into").select("vid", "size", "part"))
        for r in range(rounds):
            labels = keep(_refined(w, labels, limit, 2 * (depth * rounds + r)))
    out = cut(labels.select("vid", "part"), "parts")
    discard(spark, held)
    return out


def edge_cut(graph: Graph, parts: DataFrame) -> DataFrame:
    """One row: edges without loops, and those of them between parts(vid, part)."""
    at = lambda end: parts.select(F.col("vid").alias(end), F.col("part").alias(f"p{end}"))
    e = graph.without_self_loops().edges.join(at("src"), "src").join(at("dst"), "dst")
    return e.agg(F.count("*").alias("edges"), F.count(F.when(F.col("psrc") != F.col("pdst"), 1)).alias("cut"))
