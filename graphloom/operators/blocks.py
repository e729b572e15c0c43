"""Sampled blocks: for each batch of seeds and each hop, a bipartite graph with local ids. The destinations of hop 0 are the seeds, those of
a further hop the sources of the one before it. Layer l of L walks hop L - 1 - l, and the adjoint walks back.

Local ids are dense per batch and side: sources are numbered in the order in which they first occur, going through the destinations and
each one's draws. A batch is bounded by its seeds and fanouts, so one batch fits in a row or a task; batches are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .sampling import relabel, sample_for
from .vectors import sum_vectors, zeros


def numbered_seeds(batches: DataFrame) -> DataFrame:
    """batches(batch_id, vid) -> (batch_id, vid, local), in the order of vid."""
    return relabel(batches, "vid", "vid", ("batch_id",))


def sample_blocks(graph: Graph, batches: DataFrame, fanouts: list[int], seed: int = 0) -> DataFrame:
    """batches(batch_id, vid) -> (batch_id, hop, dst, src, dst_local, src_local, w): w is the weight of the whole graph. A fanout for each
    hop; repeated edges are drawn as edges of their own."""
    degree = lambda end: graph.edges.groupBy(end).agg(F.count("*").alias(f"__{end}"))
    out, front = None, numbered_seeds(batches).select("batch_id", F.col("vid").alias("dst"), F.col("local").alias("dst_local"))
    for hop, fanout in enumerate(fanouts):
        drawn = sample_for(graph.edges, front, fanout, seed + hop, rank="__r")
        drawn = drawn.withColumn("__p", F.col("dst_local") * fanout + F.col("__r"))
        names = relabel(drawn, "__p", "src", ("batch_id",)).select("batch_id", F.col("vid").alias("src"), F.col("local").alias("src_local"))
        layer = drawn.join(names, ["batch_id", "src"]).select("batch_id", F.lit(hop).alias("hop"), "dst", "src", "dst_local", "src_local")
        out = layer if out is None else out.union(layer)
        front = names.select("batch_id", F.col("src").alias("dst"), F.col("src_local").alias("dst_local"))
    w = 1 / (F.sqrt("__src") * F.sqrt("__dst"))
    return out.join(degree("src"), "src").join(degree("dst"), "dst").select("batch_id", "hop", "dst", "src", "dst_local", "src_local", w.alias("w"))


def sources_of(blocks: DataFrame, hop: int) -> DataFrame:
    """(batch_id, vid, local): the sources of a hop."""
    return blocks.filter(F.col("hop") == hop).select("batch_id", F.col("src").alias("vid"), F.col("src_local").alias("local")).distinct()


class BlockAggregate:
    """y[dst] = sum of w * x[src] over one hop of all batches; frames are (batch_id, local, h)."""

    def __init__(self, blocks: DataFrame, batches: DataFrame, hop: int, width: int):
        self.edges, self.width = blocks.filter(F.col("hop") == hop), width
        self.sources = sources_of(blocks, hop).select("batch_id", "local")
        self.destinations = (sources_of(blocks, hop - 1) if hop else numbered_seeds(batches)).select("batch_id", "local")

    def _sum(self, x: DataFrame, given: str, to: str, rows: DataFrame) -> DataFrame:
        m = self.edges.join(x.select("batch_id", F.col("local").alias(given), F.col("h").alias("m")), ["batch_id", given])
        y = sum_vectors(m, ["batch_id", to], self.width, weight=F.col("w")).withColumnRenamed(to, "local")
        return rows.join(y, ["batch_id", "local"], "left").select("batch_id", "local", F.coalesce("h", zeros(self.width)).alias("h"))

    def forward(self, x: DataFrame) -> DataFrame:
        return self._sum(x, "src_local", "dst_local", self.destinations)

    def backward(self, g: DataFrame) -> DataFrame:
        return self._sum(g, "dst_local", "src_local", self.sources)
