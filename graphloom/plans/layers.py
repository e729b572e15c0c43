"""Layers with hand-written adjoints. A layer keeps what its backward pass needs from the last forward pass; frames are (vid, h)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nn
from ..operators.cells import AT_ONCE, list_rows, over_cells
from ..operators.graph import Graph
from ..operators.messages import Aggregate
from ..operators.vectors import WIDE, add, dot, over_vertices, scale, sum_vectors, zeros
from ..sources.shared import cut, discard


def literal(v) -> Column:
    """A vector of the driver's as an array of numbers in the plan."""
    return F.array(*[F.lit(float(a)) for a in v])


def with_vectors(x: DataFrame, **vectors) -> DataFrame:
    """x with vectors of the driver's as columns: as expressions if they are short, else as one broadcast row, so that plans stay short."""
    if sum(map(len, vectors.values())) <= WIDE:
        return x.withColumns({k: literal(v) for k, v in vectors.items()})
    row = x.sparkSession.createDataFrame([tuple([float(a) for a in v] for v in vectors.values())], ", ".join(f"{k} array<double>" for k in vectors))
    return x.join(F.broadcast(row))


def with_gradient(x: DataFrame, g: DataFrame) -> DataFrame:
    return x.join(g.select("vid", F.col("h").alias("g")), "vid")


def outer_sums(frames: list[tuple[DataFrame, int, int]]) -> list[np.ndarray]:
    """The sum of h^T g over the rows of each frame (h, g), all in one job: a product per batch, a sum per partition, and a tree of sums
    whose last few are added on the driver, which holds the weights of the same shapes."""
    sizes = [(r, c) for _, r, c in frames]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            tags = b.column("tag").to_numpy()
            for tag in np.unique(tags).tolist():
                own = b.filter(pa.array(tags == tag))
                x, g = (own.column(c).flatten().to_numpy().reshape(own.num_rows, -1) for c in ("h", "g"))
                total[tag] = total.get(tag, 0.0) + x.T @ g
        for tag, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([tag], pa.int32()), pa.array([s.ravel()], pa.list_(pa.float64()))], ["tag", "s"])

    tagged = [f.select(F.lit(i).alias("tag"), "h", "g") for i, (f, _, _) in enumerate(frames)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.union(t)
    out = [np.zeros(r * c) for r, c in sizes]
    for r in tree_sum(every.mapInArrow(run, "tag int, s array<double>")).collect():
        out[r["tag"]] += r["s"]
    return [o.reshape(s) for o, s in zip(out, sizes)]


def tree_sum(parts: DataFrame, fan: int = 16) -> DataFrame:
    """(tag, s): at most `fan` arrays a tag whose sum is that of all arrays with the tag. Arrays are added up as a whole in one more
    step, dealt out to `fan` tasks where there are more partitions; an entry is never a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            for i, tag in enumerate(b.column("tag").to_pylist()):
                s = b.column("s")[i].values.to_numpy()
                total[tag] = total[tag] + s if tag in total else s
        for tag, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([tag], pa.int32()), pa.array([s], pa.list_(pa.float64()))], ["tag", "s"])

    return parts.repartition(fan).mapInArrow(run, "tag int, s array<double>")


class Layer:
    #: Whether what comes out of the forward and of the backward pass is worth a table while training.
    cuts = (False, False)

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        #: Frames (h, g) whose summed products are the gradients of the weights.
        self.pending: dict[str, DataFrame] = {}

    def forward(self, x: DataFrame, training: bool = True) -> DataFrame:
        raise NotImplementedError

    def backward(self, g: DataFrame, wanted: bool = True) -> DataFrame:
        """The gradient of the input, given that of the output. Where it isn't wanted, only those of weights are."""
        raise NotImplementedError

    def layers(self) -> list[Layer]:
        return [self]

    def learned(self) -> list[Layer]:
        return [p for p in self.layers() if p.weights]

    @property
    def grads(self) -> dict[str, np.ndarray]:
        return gradients([self])[0]

    def release(self) -> None:
        """Let go of what was kept for the backward pass."""


def gradients(layers: list[Layer]) -> list[dict[str, np.ndarray]]:
    """The gradients of all weights after a backward pass, by one job."""
    names = [(i, k) for i, p in enumerate(layers) for k in p.pending]
    shape = lambda w: (w.shape[0], w.shape[1] if w.ndim > 1 else 1)
    out = [{} for _ in layers]
    if names:
        for (i, k), s in zip(names, outer_sums([(layers[i].pending[k], *shape(layers[i].weights[k])) for i, k in names])):
            out[i][k] = s.reshape(layers[i].weights[k].shape)
    return out


class Linear(Layer):
    def __init__(self, w: np.ndarray):
        super().__init__()
        self.weights = {"w": w}

    def forward(self, x, training=True):
        self.x = x
        return nn.linear(x, self.weights["w"])

    def backward(self, g, wanted=True):
        self.pending = {"w": with_gradient(self.x, g)}
        return nn.linear(g, self.weights["w"].T)


class Relu(Layer):
    def forward(self, x, training=True):
        self.x = x
        return x.select("vid", nn.relu(F.col("h")).alias("h"))

    def backward(self, g, wanted=True):
        return with_gradient(self.x, g).select("vid", F.zip_with("h", "g", lambda v, d: F.when(v > 0, d).otherwise(0.0)).alias("h"))


class Dropout(Layer):
    """Decisions are hashed from vertex, element and epoch, and replayed by the backward pass. Off outside of training."""

    def __init__(self, rate: float, seed: int = 0):
        super().__init__()
        self.rate, self.seed, self.epoch, self.on = rate, seed, 0, False

    def _drop(self, x):
        return x.select("vid", nn.dropout(F.col("h"), F.col("vid"), self.rate, self.seed, self.epoch).alias("h")) if self.on else x

    def forward(self, x, training=True):
        self.on = training and self.rate > 0
        self.epoch += training
        return self._drop(x)

    def backward(self, g, wanted=True):
        return self._drop(g)


class Elementwise(Layer):
    """A function of the caller's, applied to each element, and its slope: both take and give a column."""

    def __init__(self, function, slope):
        super().__init__()
        self.function, self.slope = function, slope

    def forward(self, x, training=True):
        self.x = x
        return x.select("vid", F.transform("h", self.function).alias("h"))

    def backward(self, g, wanted=True):
        return with_gradient(self.x, g).select("vid", F.zip_with("h", "g", lambda v, d: self.slope(v) * d).alias("h"))


class BatchNorm(Layer):
    """Statistics are two numbers per element: they are worked out once in the forward pass and joined as one row from then on."""

    cuts = (False, True)

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def forward(self, x, training=True):
        row = nn.batch_statistics(x, self.width).first()
        self.spread = np.sqrt(np.array(row["va"]) + nn.EPS)
        z = with_vectors(x.select("vid", "h"), mu=row["mu"], s=self.spread)
        self.z = z.select("vid", F.zip_with(F.zip_with("h", "mu", lambda a, m: a - m), "s", lambda a, s: a / s).alias("h"))
        return self.z

    def backward(self, g, wanted=True):
        xg = with_gradient(self.z, g)
        means = nn.batch_statistics(xg.select(F.concat("g", F.zip_with("g", "h", lambda a, b: a * b)).alias("h")), 2 * self.width).first()["mu"]
        table = with_vectors(xg.select("vid", "h", "g"), mg=means[: self.width], mgz=means[self.width :], s=self.spread)
        return table.select("vid", F.transform(F.arrays_zip("h", "g", "mg", "mgz", "s"), lambda a: (a["g"] - a["mg"] - a["h"] * a["mgz"]) / a["s"]).alias("h"))


class Gather(Layer):
    """A graph aggregation as a layer."""

    cuts = (True, True)

    def __init__(self, op: Aggregate):
        super().__init__()
        self.op = op

    def forward(self, x, training=True):
        return self.op.forward(x)

    def backward(self, g, wanted=True):
        return self.op.backward(g)


class Attention(Layer):
    """y = sum over in-edges of softmax(leaky(al . h_src + ar . h_dst)) * h_src. Edges meet the vectors of their ends in cells, each of which
    sums by vertex: relative to its own largest score in the forward pass, whose largest scores and sums of all cells (two numbers a
    vertex) give the weights again in the backward pass. The mean of the gradients of a dst's weights is y . g. While
    training, what comes out of both passes is written until `release`, as it is read more than once."""

    cuts = (False, True)

    def __init__(self, graph: Graph, al: np.ndarray, ar: np.ndarray):
        super().__init__()
        self.graph, self.width, self.held = graph, len(al), []
        self.weights = {"al": al, "ar": ar}

    def _scored(self, x, k):
        return dot(F.col("h"), literal(self.weights[k]))

    def _over(self, of_src, of_dst, work, schema):
        return over_cells(self.graph.edges, of_src, of_dst, self.graph.vertices.count(), work, schema)

    def forward(self, x, training=True):
        self.x, n = x, self.width
        of_src, of_dst = (x.select("vid", v.alias("h")) for v in (F.concat("h", F.array(self._scored(x, "al"))), F.array(self._scored(x, "ar"))))
        parts = self._over(of_src, of_dst, attended, "vid long, top double, m array<double>")
        # a row a cell of the vertex's block: the largest score of all, and sums of what each cell has, relative to it
        parts = parts.withColumn("all", F.max("top").over(Window.partitionBy("vid")))
        y = parts.groupBy("vid").agg(F.max("all").alias("top"), F.array(*[F.sum(F.col("m")[i] * F.exp(F.col("top") - F.col("all"))) for i in range(n + 1)]).alias("m"))
        y = self.graph.vertices.select("vid").join(y, "vid", "left").select("vid", F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce(F.col("m")[n], F.lit(1.0)).alias("total"), F.coalesce(F.slice("m", 1, n), zeros(n)).alias("m"))
        y = y.select("vid", "top", "total", scale(F.col("m"), 1 / F.col("total")).alias("h"))
        self.y = cut(y, held=self.held) if training else y
        return self.y.select("vid", "h")

    def backward(self, g, wanted=True):
        x, n = self.x, self.width
        y = with_gradient(self.y, g).join(x.select("vid", self._scored(x, "ar").alias("pr")), "vid")
        of_dst = y.select("vid", F.concat("g", F.array("pr", "top", "total", dot(F.col("h"), F.col("g")))).alias("h"))
        of_src = x.select("vid", F.concat("h", F.array(self._scored(x, "al"))).alias("h"))
        sums = sum_vectors(self._over(of_src, of_dst, attended_back, "vid long, m array<double>"), "vid", n + 2)
        sums = cut(over_vertices(self.graph.vertices, sums, "vid", n + 2), held=self.held)
        self.pending = {k: with_gradient(x, sums).select("h", F.array(F.col("g")[n + i]).alias("g")) for i, k in enumerate(("al", "ar"))}
        al, ar = (scale(literal(self.weights[k]), F.col("h")[n + i]) for i, k in enumerate(("al", "ar")))
        return sums.select("vid", add(F.slice("h", 1, n), add(al, ar)).alias("h"))

    def release(self):
        if self.held:
            discard(SparkSession.active(), self.held)


def attended(a_ids, a, b_ids, b, src, dst) -> Iterator[pa.RecordBatch]:
    """(vid, top, m) of each dst of a cell: its largest score, and the sum of exp(score - top) times (h_src, 1)."""
    score = a[src, -1] + b[dst, 0]
    score = np.where(score > 0, score, 0.2 * score)
    order = np.argsort(dst, kind="stable")
    src, dst, score = src[order], dst[order], score[order]
    top = np.full(len(b_ids), -np.inf)
    np.maximum.at(top, dst, score)
    h = a.copy()
    h[:, -1] = 1.0
    m = _summed(dst, len(b_ids), h.shape[1], lambda e: np.exp(score[e] - top[dst[e]])[:, None] * h[src[e]])
    own = np.unique(dst)
    yield from list_rows(["vid", "top", "m"], b_ids[own], top[own], m[own])


def attended_back(a_ids, a, b_ids, b, src, dst) -> Iterator[pa.RecordBatch]:
    """(vid, m): the sums over the edges of a cell of (w g_dst, gradient of the score, 0) by src and (0, 0, gradient of the score) by dst."""
    n = a.shape[1] - 1
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    z = a[src, -1] + b[dst, n]
    w = np.exp(np.where(z > 0, z, 0.2 * z) - b[dst, n + 1]) / b[dst, n + 2]
    gz = np.empty(len(src))
    for i in range(0, len(src), AT_ONCE):
        e = slice(i, i + AT_ONCE)
        gz[e] = w[e] * (np.einsum("ij,ij->i", a[src[e], :n], b[dst[e], :n]) - b[dst[e], n + 3])
    gz = np.where(z > 0, gz, 0.2 * gz)
    m = np.zeros((len(a_ids), n + 2))
    m[:, :n] = _summed(src, len(a_ids), n, lambda e: w[e][:, None] * b[dst[e], :n])
    m[:, n] = np.bincount(src, gz, len(a_ids))
    own = np.unique(src)
    yield from list_rows(["vid", "m"], a_ids[own], m[own])
    m = np.zeros((len(b_ids), n + 2))
    m[:, n + 1] = np.bincount(dst, gz, len(b_ids))
    own = np.unique(dst)
    yield from list_rows(["vid", "m"], b_ids[own], m[own])


def _summed(at: np.ndarray, rows: int, width: int, values) -> np.ndarray:
    """Sums by place of vectors that are made for some edges at a time; places are in order."""
    out = np.zeros((rows, width))
    for i in range(0, len(at), AT_ONCE):
        e = slice(i, i + AT_ONCE)
        own = at[e]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[first]] += np.add.reduceat(values(e), first)
    return out


class Chain(Layer):
    """Layers one after another. While training, what comes out of a layer that shuffles is written to the shared folder until `release`,
    as the backward pass comes back to it: plans stay as short as the way to the last table. The layers between are worked out anew
    from there, which also makes them free to keep. A first layer without weights isn't run again for an input it has seen."""

    def __init__(self, *steps: Layer):
        super().__init__()
        self.steps, self.held, self.first = steps, [], None

    def forward(self, x, training=True):
        for i, s in enumerate(self.steps):
            if not (training and s.cuts[0]):
                x = s.forward(x, training)
            elif i or s.learned():
                x = cut(s.forward(x, training), held=self.held)
            else:
                if self.first is None or self.first[0] is not x:
                    self.first = x, cut(s.forward(x, training))
                x = self.first[1]
        return x

    def backward(self, g, wanted=True):
        for i in reversed(range(len(self.steps))):
            s = self.steps[i]
            below = wanted or any(p.learned() for p in self.steps[:i])
            if not below and not s.learned():
                break
            g = s.backward(g, below)
            if below and s.cuts[1]:
                g = cut(g, held=self.held)
        return g

    def release(self):
        if self.held:
            discard(SparkSession.active(), self.held)
        for s in self.steps:
            s.release()

    def layers(self):
        return [x for s in self.steps for x in s.layers()]


class Recomputed(Layer):
    """A layer that keeps its input only: its forward pass is run again when the backward pass comes to it."""

    cuts = (True, True)

    def __init__(self, inner: Layer):
        super().__init__()
        self.inner = inner

    def _epochs(self) -> list[int]:
        return [p.epoch for p in self.inner.layers() if isinstance(p, Dropout)]

    def forward(self, x, training=True):
        self.x, self.drawn = x, self._epochs()
        out = self.inner.forward(x, training)
        self.inner.release()
        return out

    def backward(self, g, wanted=True):
        # dropout draws what it drew before
        for p, epoch in zip((p for p in self.inner.layers() if isinstance(p, Dropout)), self.drawn):
            p.epoch = epoch
        self.inner.forward(self.x, True)
        return self.inner.backward(g, wanted)

    def release(self):
        self.inner.release()

    def layers(self):
        return self.inner.layers()


class Sum(Layer):
    """Branches over the same input, added up."""

    cuts = (True, True)

    def __init__(self, *branches: Layer):
        super().__init__()
        self.branches = branches

    def _sum(self, parts):
        out = parts[0]
        for p in parts[1:]:
            out = with_gradient(out, p).select("vid", add(F.col("h"), F.col("g")).alias("h"))
        return out

    def forward(self, x, training=True):
        return self._sum([b.forward(x, training) for b in self.branches])

    def backward(self, g, wanted=True):
        parts = [b.backward(g, wanted) for b in self.branches]
        return self._sum(parts) if wanted else None

    def release(self):
        for b in self.branches:
            b.release()

    def layers(self):
        return [x for b in self.branches for x in b.layers()]


class Same(Layer):
    def forward(self, x, training=True):
        return x

    def backward(self, g, wanted=True):
        return g


class LogSoftmax(Layer):
    def forward(self, x, training=True):
        self.x = x
        return x.select("vid", nn.log_softmax(F.col("h")).alias("h"))

    def backward(self, g, wanted=True):
        y = with_gradient(self.x.select("vid", nn.log_softmax(F.col("h")).alias("h")), g)
        total = F.aggregate("g", F.lit(0.0), lambda s, v: s + v)
        return y.withColumn("t", total).select("vid", F.zip_with("h", "g", lambda v, d: d - F.exp(v) * F.col("t")).alias("h"))


def loss_gradient(out: DataFrame, truth: DataFrame, train: int = 0, n: int | None = None) -> DataFrame:
    """The gradient of the mean negative log-likelihood over the n rows of the training mask; out holds log-probabilities."""
    n = truth.filter(F.col("mask") == train).count() if n is None else n
    rows = out.join(truth.select("vid", "label", "mask"), "vid")
    hit = F.transform("h", lambda v, i: F.when((F.col("mask") == train) & (i == F.col("label").cast("int")), -1.0 / max(n, 1)).otherwise(0.0))
    return rows.select("vid", hit.alias("h"))
