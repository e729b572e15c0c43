"""The graph: vertices (vid) and edges (src, dst) as DataFrames, kept as a bag. Messages flow from src to dst."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import running_sum

#: Vertex ranges of a partition end at multiples of this.
PAGE = 1024


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    # structure

    def transpose(self) -> Graph:
        return Graph(self.vertices, flip(self.edges))

    def symmetrize(self, distinct: bool = False) -> Graph:
        both = self.edges.union(flip(self.edges))
        return Graph(self.vertices, both.distinct() if distinct else both)

    def without_self_loops(self) -> Graph:
        return Graph(self.vertices, self.edges.filter("src <> dst"))

    def with_self_loops(self) -> Graph:
        """One loop per vertex, whatever loops there were."""
        loops = self.vertices.select(F.col("vid").alias("src"), F.col("vid").alias("dst"))
        return Graph(self.vertices, self.without_self_loops().edges.union(loops))

    def dedup(self) -> Graph:
        return Graph(self.vertices, self.edges.dropDuplicates(["src", "dst"]))

    def active(self, condition: Column) -> Graph:
        """The graph of the vertices for which the condition over vertices holds."""
        live = self.vertices.filter(condition)
        ids = live.select("vid")
        e = self.edges.join(ids.withColumnRenamed("vid", "src"), "src", "left_semi").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi")
        return Graph(live, e.select("src", "dst"))

    # degrees and weights

    def degrees(self, end: str) -> DataFrame:
        """(vid, degree) of every vertex; end is "src" for out-degrees and "dst" for in-degrees."""
        n = self.edges.groupBy(F.col(end).alias("vid")).agg(F.count("*").alias("degree"))
        return self.vertices.select("vid").join(n, "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    @cached_property
    def norm_weights(self) -> DataFrame:
        """(src, dst, w): w = 1 / (sqrt(out-degree of src) * sqrt(in-degree of dst)). Ends of edges have degree 1 or more."""
        out = self.edges.groupBy("src").agg(F.count("*").alias("o"))
        into = self.edges.groupBy("dst").agg(F.count("*").alias("i"))
        return self.edges.join(out, "src").join(into, "dst").select("src", "dst", (1 / (F.sqrt("o") * F.sqrt("i"))).alias("w"))

    def weights(self, fn: Callable[[Column, Column], Column]) -> DataFrame:
        return self.edges.select("src", "dst", fn(F.col("src"), F.col("dst")).cast("double").alias("w"))

    # compressed layouts

    def offsets(self, end: str) -> DataFrame:
        """(vid, start): where each vertex's edges begin in the order of `end` (dst: by column, src: by row)."""
        return running_sum(self.degrees(end), "vid", "degree", "start").select("vid", F.col("start").cast("long").alias("start"))

    def edge_ids(self) -> DataFrame:
        """(src, dst, eid): the place of each edge in the order of dst, then src."""
        own = F.row_number().over(Window.partitionBy("dst").orderBy("src")) - 1
        at = self.offsets("dst").withColumnRenamed("vid", "dst")
        return self.edges.withColumn("own", own).join(at, "dst").select("src", "dst", (F.col("start") + F.col("own")).alias("eid"))

    def mirrors(self) -> DataFrame:
        """(vid, slot): a dense number for every vertex that has out-edges."""
        live = self.edges.select(F.col("src").alias("vid")).distinct().withColumn("one", F.lit(1))
        return running_sum(live, "vid", "one", "slot").select("vid", F.col("slot").cast("long").alias("slot"))

    def mirrored_at(self, owner: Callable[[Column], Column]) -> DataFrame:
        """(p, vid): the sources that partition p needs for the in-edges of its vertices."""
        return self.edges.select(owner(F.col("dst")).alias("p"), F.col("src").alias("vid")).distinct()

    def mirror_slots(self, owner: Callable[[Column], Column]) -> DataFrame:
        """(p, vid, slot): mirrored_at() with a dense number in each partition, in the order of vid."""
        d = running_sum(self.mirrored_at(owner).withColumn("one", F.lit(1)), "vid", "one", "slot", group=("p",))
        return d.select("p", "vid", F.col("slot").cast("long").alias("slot"))

    def slot_offsets(self, owner: Callable[[Column], Column]) -> DataFrame:
        """(p, slot, vid, start, degree): the compressed rows of each partition. A row is a mirror of a source, numbered by slot, and its
        edges are those into the partition's vertices."""
        degree = self.edges.groupBy(owner(F.col("dst")).alias("p"), F.col("src").alias("vid")).agg(F.count("*").alias("degree"))
        rows = self.mirror_slots(owner).join(degree, ["p", "vid"])
        return running_sum(rows, "slot", "degree", "start", group=("p",)).select("p", "slot", "vid", F.col("start").cast("long").alias("start"), "degree")

    def slot_edges(self, owner: Callable[[Column], Column]) -> DataFrame:
        """(p, slot, place, dst): the edges of slot_offsets(), each at its place in the partition, a row's in the order of dst."""
        rows = self.slot_offsets(owner).select("p", F.col("vid").alias("src"), "slot", "start")
        own = F.row_number().over(Window.partitionBy("p", "src").orderBy("dst")) - 1
        e = self.edges.withColumn("p", owner(F.col("dst"))).withColumn("own", own).join(rows, ["p", "src"])
        return e.select("p", "slot", (F.col("start") + F.col("own")).alias("place"), "dst")

    def message_lists(self, owner: Callable[[Column], Column]) -> DataFrame:
        """(owner, needer, place, vid, slot): the vertices that a partition sends to another one (or needs itself), in order, and the slot that
        each takes there."""
        m = self.mirror_slots(owner).select(owner(F.col("vid")).alias("owner"), F.col("p").alias("needer"), "vid", "slot").withColumn("one", F.lit(1))
        return running_sum(m, "vid", "one", "place", group=("owner", "needer")).select("owner", "needer", F.col("place").cast("long").alias("place"), "vid", "slot")

    def chunks(self, owner: Callable[[Column], Column]) -> DataFrame:
        """(psrc, pdst, edges): edges between partitions."""
        return self.edges.groupBy(owner(F.col("src")).alias("psrc"), owner(F.col("dst")).alias("pdst")).agg(F.count("*").alias("edges"))

    # statistics

    def degree_histogram(self, end: str = "src") -> DataFrame:
        """(bucket, vertices, share): vertices by the whole part of log2 of their degree; -1 for degree 0."""
        d = self.degrees(end).select(F.when(F.col("degree") == 0, -1).otherwise(F.length(F.bin("degree")) - 1).alias("bucket"))
        n = d.groupBy("bucket").agg(F.count("*").alias("vertices"))
        return n.select("bucket", "vertices", (F.col("vertices") * 100.0 / F.sum("vertices").over(Window.partitionBy())).alias("share"))

    def degree_summary(self, end: str = "src") -> DataFrame:
        """One row: the largest degree, the mean in whole edges, and the first vertex with the largest degree."""
        d = self.degrees(end)
        top = F.max(F.struct("degree", (-F.col("vid")).alias("v"))).alias("t")
        return d.agg(top, F.floor(F.sum("degree") / F.count("*")).cast("long").alias("mean_degree")).select(F.col("t.degree").alias("max_degree"), "mean_degree", (-F.col("t.v")).alias("vid"))


def flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def owner_of(bounds: list[int]) -> Callable[[Column], Column]:
    """The partition of a vertex, given the first vertices of the partitions and the number of vertices at the end."""
    return lambda v: sum((F.when(v >= b, 1).otherwise(0) for b in bounds[1:-1]), F.lit(0))


def partition_bounds(graph: Graph, parts: int, page: int = PAGE, alpha: float | None = None) -> list[int]:
    """Contiguous vertex ranges of about equal load, a vertex counting out-degree + alpha. Each range takes an even share of
    what is left and ends at a multiple of `page`. Loads are summed by page on Spark, so the driver walks pages only."""
    alpha = 12.0 * (parts + 1) if alpha is None else alpha
    d = graph.degrees("src").select(F.col("vid"), (F.col("degree") + alpha).alias("load"))
    pages = {int(r["p"]): r["load"] for r in d.groupBy(F.floor(F.col("vid") / page).alias("p")).agg(F.sum("load").alias("load")).collect()}
    total, last = sum(pages.values()), (max(pages) + 1 if pages else 0)
    size = graph.vertices.count()
    bounds, at, left = [0], 0, total
    for i in range(parts - 1):
        share, held = left / (parts - i), 0.0
        while at < last and held + pages.get(at, 0.0) <= share:
            held += pages.get(at, 0.0)
            at += 1
        left -= held
        bounds.append(min(at * page, size))
    return [*bounds, size]
