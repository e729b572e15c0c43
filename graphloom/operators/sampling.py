"""Neighbour sampling. Draws are ordered by an arithmetic hash of edge and seed, so that samples are the same wherever they run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_hash(seed: int) -> Column:
    return (F.col("src") * 7919 + F.col("dst") * 104729 + seed) % 1000003


def sample_neighbours(edges: DataFrame, fanout: int, seed: int = 0, group: tuple[str, ...] = (), rank: str | None = None) -> DataFrame:
    """At most `fanout` in-edges of each dst (per group, if columns are given), drawn without replacement. The order of the draws, from 1,
    is kept as a column if `rank` names one."""
    own = Window.partitionBy(*group, "dst").orderBy(edge_hash(seed), "src")
    drawn = edges.withColumn(rank or "__r", F.row_number().over(own)).filter(F.col(rank or "__r") <= fanout)
    return drawn if rank else drawn.drop("__r")


def sample_for(edges: DataFrame, front: DataFrame, fanout: int, seed: int = 0, rank: str | None = None) -> DataFrame:
    """The draws for each row of front(batch_id, dst, ...). What a dst draws depends on its edges and the seed alone, so it is drawn once,
    whatever the number of batches that ask for it."""
    asked = edges.join(front.select("dst").distinct(), "dst", "left_semi")
    return sample_neighbours(asked, fanout, seed, rank=rank).join(front, "dst")


def seed_batches(seeds: DataFrame, size: int, chunk: int = 1 << 16) -> DataFrame:
    """seeds(vid) -> (batch_id, vid): consecutive batches in the order of vid; the last may be short."""
    from .vectors import running_sum

    placed = running_sum(seeds.select("vid").withColumn("__one", F.lit(1)), "vid", "__one", "__p", chunk)
    return placed.select(F.floor(F.col("__p") / size).cast("long").alias("batch_id"), "vid")


def expand(edges: DataFrame, batches: DataFrame, fanouts: list[int], seed: int = 0) -> DataFrame:
    """batches(batch_id, vid) -> (batch_id, hop, dst, src): hop 0 draws for the seeds, each further hop for the distinct sources
    of the hop before it."""
    out, front = None, batches.select("batch_id", F.col("vid").alias("dst")).distinct()
    for hop, fanout in enumerate(fanouts):
        drawn = sample_for(edges, front, fanout, seed + hop)
        layer = drawn.select("batch_id", F.lit(hop).alias("hop"), "dst", "src")
        out = layer if out is None else out.union(layer)
        front = layer.select("batch_id", F.col("src").alias("dst")).distinct()
    return out


def relabel(rows: DataFrame, pos: str, vid: str, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, vid, local): dense numbers in the order in which ids first occur."""
    first = rows.groupBy(*group, F.col(vid).alias("vid")).agg(F.min(pos).alias("__p"))
    own = Window.partitionBy(*group).orderBy("__p")
    return first.select(*group, "vid", (F.row_number().over(own) - 1).cast("long").alias("local"))
