"""Message passing: scatters from vertices to edges, gathers from edges to vertices, and their adjoints.

Vertex tensors are (vid, h), edge tensors (src, dst, m). Every `backward` takes the gradient of an operator's output and returns
that of its input. Vertices without edges get zeros.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import edge_products, over_cells
from .graph import Graph
from .vectors import WIDE, fold_vectors, over_vertices, scale, sum_vectors, zeros


def at(edges: DataFrame, x: DataFrame, end: str, name: str) -> DataFrame:
    """The edges with the vector of their `end`."""
    return edges.join(x.select(F.col("vid").alias(end), F.col("h").alias(name)), end)


def with_totals(edges: DataFrame, **folds: Column) -> DataFrame:
    """The edges with aggregates over the in-edges of their dst. They are combined on the map side and joined back, so a hub's edges are
    never gathered in one task (adaptive execution splits its side of the join)."""
    return edges.join(edges.groupBy("dst").agg(*(c.alias(k) for k, c in folds.items())), "dst")


class Scatter:
    """m = vector of src, of dst, or both, one after the other; ends: "src", "dst" or "both"."""

    def __init__(self, graph: Graph, width: int, ends: str = "src"):
        self.graph, self.width, self.ends = graph, width, ends

    def forward(self, x: DataFrame) -> DataFrame:
        e = self.graph.edges
        if self.ends == "both":
            return at(at(e, x, "src", "a"), x, "dst", "b").select("src", "dst", F.concat("a", "b").alias("m"))
        return at(e, x, self.ends, "m").select("src", "dst", "m")

    def backward(self, g: DataFrame) -> DataFrame:
        if self.ends == "both":
            half = lambda end, first: g.select(F.col(end).alias("vid"), F.slice("m", first, self.width).alias("m"))
            g = half("src", 1).union(half("dst", self.width + 1))
        else:
            g = g.select(F.col(self.ends).alias("vid"), "m")
        return over_vertices(self.graph.vertices, sum_vectors(g, "vid", self.width), "vid", self.width)


class GatherSum:
    """y[dst] = sum of m."""

    def __init__(self, graph: Graph, width: int):
        self.graph, self.width = graph, width

    def forward(self, m: DataFrame) -> DataFrame:
        return over_vertices(self.graph.vertices, sum_vectors(m, "dst", self.width), "dst", self.width)

    def backward(self, g: DataFrame) -> DataFrame:
        return at(self.graph.edges, g, "dst", "m").select("src", "dst", "m")


class GatherExtreme:
    """y[dst] = element-wise min or max of m, with the edge that gave it. from_zero starts at 0 instead of the first message.

    The smallest src wins ties; of repeated edges one takes the gradient, so that it counts once."""

    def __init__(self, graph: Graph, width: int, kind: str = "max", from_zero: bool = False):
        self.graph, self.width, self.kind, self.from_zero = graph, width, kind, from_zero

    def forward(self, m: DataFrame) -> DataFrame:
        fold = F.max if self.kind == "max" else F.min
        y = fold_vectors(m, "dst", self.width, fold)
        if self.from_zero:
            clip = F.greatest if self.kind == "max" else F.least
            y = y.select("dst", F.transform("h", lambda v: clip(v, F.lit(0.0))).alias("h"))
        return over_vertices(self.graph.vertices, y, "dst", self.width)

    def sources(self, m: DataFrame) -> DataFrame:
        """(dst, from): for each element the src whose message was taken. Wide vectors are folded twice, in parts: to their extremes, and to
        the smallest src that has each of them."""
        if self.width > WIDE:
            top = fold_vectors(m, "dst", self.width, F.max if self.kind == "max" else F.min).withColumnRenamed("h", "__top")
            own = F.zip_with("m", "__top", lambda v, t: F.when(v == t, F.col("src")))
            return fold_vectors(m.join(top, "dst").select("dst", own.alias("m")), "dst", self.width, F.min).withColumnRenamed("h", "from")
        sign = 1 if self.kind == "max" else -1
        best = [F.max(F.struct((F.col("m")[i] * sign).alias("v"), (-F.col("src")).alias("s"))) for i in range(self.width)]
        return m.groupBy("dst").agg(F.array(*best).alias("b")).select("dst", F.transform("b", lambda s: -s.s).alias("from"))

    def backward(self, m: DataFrame, g: DataFrame) -> DataFrame:
        took = self.sources(m).join(g.select(F.col("vid").alias("dst"), "h"), "dst")
        hit = F.transform(F.arrays_zip("from", "h"), lambda z: F.when(z["from"] == F.col("src"), z.h).otherwise(0.0))
        first = F.row_number().over(Window.partitionBy("src", "dst").orderBy("dst")) == 1
        edges = self.graph.edges.withColumn("__first", first).join(took, "dst")
        return edges.select("src", "dst", F.when(F.col("__first"), hit).otherwise(zeros(self.width)).alias("m"))


class EdgeSoftmax:
    """Softmax of scores (src, dst, s) over the in-edges of each dst: (src, dst, a). Scores are numbers or, where a width is given, arrays,
    each column of which has a softmax of its own. Largest scores and sums are combined on the map side."""

    def __init__(self, width: int | None = None):
        self.width = width

    def _joined(self, edges: DataFrame, value: Column, fold, name: str) -> DataFrame:
        """The edges with an aggregate of `value` over those of their dst."""
        if self.width is None:
            return with_totals(edges, **{name: fold(value)})
        return edges.join(fold_vectors(edges.select("dst", value.alias("m")), "dst", self.width, fold).withColumnRenamed("h", name), "dst")

    def _each(self, a: str, b: str, op: Callable[[Column, Column], Column]) -> Column:
        return op(F.col(a), F.col(b)) if self.width is None else F.zip_with(a, b, op)

    def forward(self, s: DataFrame) -> DataFrame:
        e = self._joined(s, F.col("s"), F.max, "__top").select("src", "dst", self._each("s", "__top", lambda x, t: F.exp(x - t)).alias("e"))
        return self._joined(e, F.col("e"), F.sum, "__sum").select("src", "dst", self._each("e", "__sum", lambda x, t: x / t).alias("a"))

    def backward(self, ag: DataFrame) -> DataFrame:
        """(src, dst, a, g) -> (src, dst, s): a (g - sum of a g over the edges of the dst), column by column."""
        e = self._joined(ag, self._each("a", "g", lambda a, g: a * g), F.sum, "__mean").withColumn("__d", self._each("g", "__mean", lambda g, m: g - m))
        return e.select("src", "dst", self._each("a", "__d", lambda a, d: a * d).alias("s"))


class Aggregate:
    """y[dst] = sum of w * x[src] over weighted edges (src, dst, w); messages are never kept. Columns of the weights other than
    w are ignored; without weights every edge counts 1."""

    def __init__(self, graph: Graph, width: int, weights: DataFrame | None = None):
        self.graph, self.width = graph, width
        self.weights = graph.edges.withColumn("w", F.lit(1.0)) if weights is None else weights

    def _sum(self, x: DataFrame, given: str, to: str) -> DataFrame:
        m = at(self.weights, x, given, "m")
        return over_vertices(self.graph.vertices, sum_vectors(m, to, self.width, weight=F.col("w")), to, self.width)

    def forward(self, x: DataFrame) -> DataFrame:
        return self._sum(x, "src", "dst")

    def backward(self, g: DataFrame) -> DataFrame:
        return self._sum(g, "dst", "src")

    def backward_weights(self, x: DataFrame, g: DataFrame) -> DataFrame:
        """(src, dst, w): the gradient of each weight, the product of x[src] and g[dst]. Edges never carry a vector through a shuffle."""
        return over_cells(self.weights, x, g, self.graph.vertices.count(), edge_products, "src long, dst long, w double")


class BalancedAggregate(Aggregate):
    """Aggregate for graphs with hubs. Ends with more than one in SHARE of all edges, fewer than SHARE of them, are hot: the rows of hot
    giving ends are broadcast to their edges instead of gathering these in one task, and edges of hot receiving ends are summed by SALTS
    shares first. The rest is shuffled as usual."""

    SHARE, SALTS = 1024, 64

    def hot(self, end: str) -> DataFrame:
        """(end): fewer than SHARE ids, whatever the graph."""
        total = self.weights.count()
        return self.weights.groupBy(end).agg(F.count("*").alias("__n")).filter(F.col("__n") > max(16, total // self.SHARE)).select(end)

    def messages(self, x: DataFrame, given: str) -> DataFrame:
        """The edges with the vector m of their giving end."""
        x = x.select(F.col("vid").alias(given), F.col("h").alias("m"))
        hubs = F.broadcast(self.hot(given))
        few = F.broadcast(x.join(hubs, given, "left_semi"))
        return self.weights.join(few, given).unionByName(self.weights.join(hubs, given, "left_anti").join(x, given))

    def _sum(self, x: DataFrame, given: str, to: str) -> DataFrame:
        hubs = F.broadcast(self.hot(to).withColumn("__hub", F.lit(True)))
        salt = F.when(F.col("__hub"), F.pmod(F.xxhash64(given), F.lit(self.SALTS))).otherwise(0)
        m = self.messages(x, given).join(hubs, to, "left").withColumn("__salt", salt)
        first = sum_vectors(m, [to, "__salt"], self.width, weight=F.col("w")).withColumnRenamed("h", "m")
        return over_vertices(self.graph.vertices, sum_vectors(first, to, self.width), to, self.width)


def norm_aggregate(graph: Graph, width: int) -> Aggregate:
    """Aggregation with the degree-normalised weights."""
    return Aggregate(graph, width, graph.norm_weights)


def dependencies(graph: Graph, x: DataFrame) -> DataFrame:
    """Vectors of the vertices that have out-edges: what partitions must fetch."""
    return x.join(graph.edges.select(F.col("src").alias("vid")).distinct(), "vid", "left_semi")


def weighted_messages(a: DataFrame, m: DataFrame) -> DataFrame:
    """(src, dst, a) times (src, dst, m). For graphs without repeated edges."""
    return m.join(a, ["src", "dst"]).select("src", "dst", scale(F.col("m"), F.col("a")).alias("m"))


def by_position(ids: DataFrame, x: DataFrame) -> DataFrame:
    """ids(pos, vid) with the columns of x, one row per position."""
    return ids.join(x, "vid")


def map_reduce(vertices: DataFrame, condition: Column, value: Column) -> DataFrame:
    """The sum of a value over the vertices for which the condition holds."""
    return vertices.filter(condition).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
