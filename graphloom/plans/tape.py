"""Reverse-mode differentiation of graph programs.

A program is written with tensors: rows of a fixed width at vertices or at edges. Each operation is recorded as a node; the tape
goes back through the nodes from an output, adds up the gradients of a tensor that is used more than once, and writes the adjoints down as
further nodes. So gradients need no code of their own, and both passes are run in the same way:

* operations within a row (arithmetic, functions, products with weights) are columns of one frame at vertices or at edges;
* `at(end)` brings vertex rows to edges by a join, `gather(end)` sums edge rows at vertices, and `total(end)` gives each edge the sum
  over all edges with its end. at and gather are each other's adjoints, total is its own;
* edge rows are never kept: an edge frame is made anew from vertex frames wherever it is summed. Results of `gather` and of `keep` are
  written to the shared folder while training.

    def attention(x, w):
        h = (x @ w["w"]).keep()
        score = ((h @ w["al"]).at("src") + (h @ w["ar"]).at("dst")).leaky()
        return (score.softmax() * h.at("src")).gather()
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nn
from ..operators.graph import Graph
from ..operators.vectors import dot, fold_vectors, over_vertices, sum_vectors
from ..sources.shared import cut, discard
from .layers import Layer, literal

#: Products with weights of up to so many numbers are expressions; larger ones go to numpy in Arrow batches.
SMALL = 256


class Weight:
    """A weight in a program: x @ weight is a matrix product, x * weight one by elements with a weight of one row."""

    __array_priority__ = 1

    def __init__(self, name: str, value: np.ndarray):
        self.name, self.value = name, value if value.ndim == 2 else value.reshape(-1, 1)


class Tensor:
    def __init__(self, tape: Tape, op: str, inputs: tuple, place: str, width: int, detail=None):
        self.tape, self.op, self.inputs, self.place, self.width, self.detail = tape, op, inputs, place, width, detail
        #: Sums at vertices that stand between this one and the inputs.
        self.depth = max((i.depth for i in inputs), default=0) + (op in SUMMED)
        self.id = len(tape.nodes)
        tape.nodes.append(self)

    @property
    def name(self) -> str:
        return f"t{self.id}"

    def _with(self, op: str, width: int | None = None, *more: Tensor, detail=None, place: str | None = None) -> Tensor:
        return self.tape.record(op, (self, *more), place or self.place, width or self.width, detail)

    def _two(self, op: str, other) -> Tensor:
        if isinstance(other, (int, float)):
            return self._with(f"{op} number", detail=float(other))
        if self.place != other.place or self.width != other.width and 1 not in (self.width, other.width):
            raise ValueError(f"{op} of {self.place} rows of {self.width} and {other.place} rows of {other.width}")
        return self._with(op, max(self.width, other.width), other)

    def __add__(self, other) -> Tensor:
        return self._two("add", other)

    def __sub__(self, other) -> Tensor:
        return self._two("sub", other)

    def __mul__(self, other) -> Tensor:
        return self._with("weighted", detail=other) if isinstance(other, Weight) else self._two("mul", other)

    def __truediv__(self, other) -> Tensor:
        return self._two("div", other)

    def __matmul__(self, w: Weight) -> Tensor:
        if w.value.shape[0] != self.width:
            raise ValueError(f"rows of {self.width} times a weight of {w.value.shape[0]} rows")
        return self._with("product", w.value.shape[1], detail=(w, False))

    def apply(self, function: str) -> Tensor:
        """One of FUNCTIONS, element by element."""
        return self._with(function)

    def exp(self) -> Tensor:
        return self.apply("exp")

    def relu(self) -> Tensor:
        return self.apply("relu")

    def leaky(self) -> Tensor:
        return self.apply("leaky")

    def pool(self, k: int) -> Tensor:
        """Sums of k consecutive elements; all of them make one number."""
        return self._with("pool", self.width // k, detail=k)

    def spread(self, k: int) -> Tensor:
        """Each element k times."""
        return self._with("spread", self.width * k, detail=k)

    def concat(self, other: Tensor) -> Tensor:
        return self._with("concat", self.width + other.width, other)

    def part(self, start: int, width: int) -> Tensor:
        return self._with("part", width, detail=start)

    def fixed(self) -> Tensor:
        """The same rows, through which no gradient flows."""
        return self._with("fixed")

    def log_softmax(self) -> Tensor:
        """Within a row."""
        z = self - self._with("highest", 1).fixed()
        return z - z.exp().pool(self.width).apply("log")

    # between vertices and edges

    def at(self, end: str) -> Tensor:
        return self._with("at", detail=end, place="edge")

    def gather(self, end: str = "dst") -> Tensor:
        return self._with("gather", detail=end, place="vertex")

    def total(self, end: str = "dst") -> Tensor:
        return self._with("total", detail=end)

    def softmax(self, end: str = "dst") -> Tensor:
        """Of each column, over the edges with the same end."""
        e = (self - self._with("top", detail=end).fixed()).exp()
        return e / e.total(end)

    def keep(self) -> Tensor:
        """The same rows at vertices, written once while training."""
        return self._with("keep")


SUMMED = {"gather"}
#: Functions of an element, and their slopes as functions of (tensor, its function's value).
FUNCTIONS: dict[str, tuple[Callable[[Column], Column], Callable[[Tensor, Tensor], Tensor]]] = {
    "exp": (F.exp, lambda x, y: y),
    "log": (F.log, lambda x, y: x.apply("inverse")),
    "inverse": (lambda v: 1.0 / v, lambda x, y: y * y * -1.0),
    "relu": (lambda v: F.greatest(v, F.lit(0.0)), lambda x, y: x.apply("positive")),
    "positive": (lambda v: F.when(v > 0, 1.0).otherwise(0.0), lambda x, y: x * 0.0),
    "leaky": (nn.leaky, lambda x, y: x.apply("positive") * 0.8 + 0.2),
    "tanh": (F.tanh, lambda x, y: y * y * -1.0 + 1.0),
    "sigmoid": (lambda v: 1.0 / (1.0 + F.exp(-v)), lambda x, y: y * (y * -1.0 + 1.0)),
}
_PAIRS = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b}


def _column(n: Tensor, c: list[Column]) -> Column:
    """An operation within a row on the columns of its inputs."""
    op, d = n.op, n.detail
    if op in FUNCTIONS:
        return F.transform(c[0], lambda v: FUNCTIONS[op][0](v))
    if op in _PAIRS:
        a, b = n.inputs
        if a.width == b.width:
            return F.zip_with(c[0], c[1], _PAIRS[op])
        return F.transform(c[1], lambda v: _PAIRS[op](c[0][0], v)) if a.width == 1 else F.transform(c[0], lambda v: _PAIRS[op](v, c[1][0]))
    if op.endswith(" number"):
        return F.transform(c[0], lambda v: _PAIRS[op.split()[0]](v, F.lit(d)))
    if op == "weighted":
        return F.zip_with(c[0], literal(d.value.ravel()), _PAIRS["mul"])
    if op == "product":
        w = d[0].value.T if d[1] else d[0].value
        return F.array(*[dot(c[0], literal(w[:, j])) for j in range(w.shape[1])])
    if op == "pool":
        add_up = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        return F.array(add_up(c[0])) if n.width == 1 else F.transform(F.sequence(F.lit(1), F.lit(n.width * d), F.lit(d)), lambda i: add_up(F.slice(c[0], i, F.lit(d))))
    if op == "spread":
        return F.flatten(F.transform(c[0], lambda v: F.array_repeat(v, d)))
    if op == "concat":
        return F.concat(*c)
    if op == "part":
        return F.slice(c[0], d + 1, n.width)
    if op == "padded":
        before, after = d
        parts = ([F.array_repeat(F.lit(0.0), before)] if before else []) + [c[0]] + ([F.array_repeat(F.lit(0.0), after)] if after else [])
        return F.concat(*parts)
    if op == "highest":
        return F.array(F.array_max(c[0]))
    if op in ("fixed", "same"):
        return c[0]
    raise ValueError(f"no operation {op!r}")


class Tape:
    """Nodes over one graph, and the frames they are worked out in. While training, what is kept is written and listed in `held`."""

    def __init__(self, graph: Graph, training: bool = False):
        self.graph, self.training = graph, training
        self.nodes: list[Tensor] = []
        self.frames: dict[int, DataFrame] = {}
        self.held: list[str] = []
        self._known: dict[tuple, Tensor] = {}

    def record(self, op: str, inputs: tuple, place: str, width: int, detail=None) -> Tensor:
        """A node; the same operation on the same inputs is recorded once."""
        key = (op, *(i.id for i in inputs), place, width, id(detail[0]) if op == "product" else detail if not isinstance(detail, Weight) else id(detail), op == "product" and detail[1])
        if op == "input" or key not in self._known:
            self._known[key] = Tensor(self, op, inputs, place, width, detail)
        return self._known[key]

    def input(self, x: DataFrame, width: int) -> Tensor:
        """x(vid, h), a row for each vertex."""
        n = self.record("input", (), "vertex", width)
        self.frames[n.id] = x
        return n

    # frames

    @staticmethod
    def _needed(nodes: Iterable[Tensor], bases: set[str]) -> dict[int, Tensor]:
        found, front = {}, list(nodes)
        while front:
            n = front.pop()
            if n.id not in found:
                found[n.id] = n
                if n.op not in bases:
                    front.extend(n.inputs)
        return dict(sorted(found.items()))

    def _within(self, df: DataFrame, nodes: list[Tensor]) -> DataFrame:
        """df with columns for nodes whose inputs it has, level by level."""
        while nodes:
            ready = [n for n in nodes if all(i.name in df.columns for i in n.inputs)]
            large = [n for n in ready if n.op == "product" and n.detail[0].value.size > SMALL]
            df = df.withColumns({n.name: _column(n, [F.col(i.name) for i in n.inputs]) for n in ready if n not in large})
            for n in large:
                w = n.detail[0].value.T if n.detail[1] else n.detail[0].value
                df = nn.linear(df.withColumn(n.name, F.col(n.inputs[0].name)), w, n.name)
            nodes = [n for n in nodes if n not in ready]
        return df

    def _written(self, df: DataFrame) -> DataFrame:
        return cut(df, held=self.held) if self.training else df

    def _sum(self, nodes: list[Tensor]) -> None:
        """Sums at vertices of edge rows with one end: all of them in one pass, as one vector."""
        end, width = nodes[0].detail, sum(n.width for n in nodes)
        rows = self.edges([n.inputs[0] for n in nodes])
        m = rows.select(F.col(end), F.concat(*(F.col(n.inputs[0].name) for n in nodes)).alias("m"))
        y = self._written(over_vertices(self.graph.vertices, sum_vectors(m, end, width), end, width))
        at = 0
        for n in nodes:
            self.frames[n.id] = y.select("vid", F.slice("h", at + 1, n.width).alias("h")) if len(nodes) > 1 else y
            at += n.width

    def vertices(self, nodes: list[Tensor]) -> DataFrame:
        """(vid, a column for each node)"""
        bases = {"input", "gather", "keep"}
        needed = self._needed(nodes, bases)
        waiting = sorted({(n.depth, n.detail) for n in needed.values() if n.op == "gather" and n.id not in self.frames})
        for depth, end in waiting:
            self._sum([n for n in needed.values() if n.op == "gather" and n.id not in self.frames and (n.depth, n.detail) == (depth, end)])
        for n in needed.values():
            if n.op == "keep" and n.id not in self.frames:
                self.frames[n.id] = self._written(self.vertices([n.inputs[0]]).select("vid", F.col(n.inputs[0].name).alias("h")))
        given = [n for n in needed.values() if n.op in bases]
        df = self.frames[given[0].id].select("vid", F.col("h").alias(given[0].name))
        for n in given[1:]:
            df = df.join(self.frames[n.id].select("vid", F.col("h").alias(n.name)), "vid")
        df = self._within(df, [n for n in needed.values() if n.op not in bases])
        return df.select("vid", *(F.col(n.name) for n in {n.id: n for n in nodes}.values()))

    def edges(self, nodes: list[Tensor]) -> DataFrame:
        """(src, dst, a column for each node)"""
        needed = self._needed(nodes, {"at"})
        df = self.graph.edges.select("src", "dst")
        for end in ("src", "dst"):
            brought = [n for n in needed.values() if n.op == "at" and n.detail == end]
            if brought:
                x = self.vertices([n.inputs[0] for n in brought])
                df = df.join(x.select(F.col("vid").alias(end), *(F.col(n.inputs[0].name).alias(n.name) for n in brought)), end)
        left = [n for n in needed.values() if n.op != "at"]
        folds = {"total": F.sum, "top": F.max}
        while left:
            # what needs no total that isn't there yet, then all totals over one end whose rows are there
            later: set[int] = set()
            for n in left:
                if n.op in folds or any(i.id in later for i in n.inputs):
                    later.add(n.id)
            df = self._within(df, [n for n in left if n.id not in later])
            left = [n for n in left if n.id in later]
            ready = [n for n in left if n.op in folds and n.inputs[0].name in df.columns]
            own = [n for n in ready if (n.op, n.detail) == (ready[0].op, ready[0].detail)]
            if own:
                end = own[0].detail
                rows = df.select(end, F.concat(*(F.col(n.inputs[0].name) for n in own)).alias("m"))
                sums, at = fold_vectors(rows, end, sum(n.width for n in own), folds[own[0].op]), 0
                for n in own:
                    sums = sums.withColumn(n.name, F.slice("h", at + 1, n.width))
                    at += n.width
                df = df.join(sums.drop("h"), end)
                left = [n for n in left if n not in own]
        return df.select("src", "dst", *(F.col(n.name) for n in {n.id: n for n in nodes}.values()))

    def rows(self, nodes: list[Tensor]) -> DataFrame:
        return self.vertices(nodes) if nodes[0].place == "vertex" else self.edges(nodes)

    # gradients

    def gradients(self, out: Tensor, seed: Tensor) -> tuple[dict[int, Tensor], list[tuple[Weight, Tensor | None, Tensor]]]:
        """(gradients by node, (weight, x, g) whose summed products x^T g are the gradients of the weights), given that of `out`. x is None for
        a weight of one row, whose gradient is the sum of g."""
        grads, uses = {out.id: seed}, []

        def give(n: Tensor, g: Tensor) -> None:
            if n.width == 1 and g.width > 1:
                g = g.pool(g.width)
            grads[n.id] = grads[n.id] + g if n.id in grads else g

        for n in reversed(self.nodes[: out.id + 1]):
            g = grads.get(n.id)
            if g is None or not n.inputs:
                continue
            x, op, d = n.inputs[0], n.op, n.detail
            if op in FUNCTIONS:
                give(x, g * FUNCTIONS[op][1](x, n))
            elif op in ("add", "sub"):
                give(x, g)
                give(n.inputs[1], g if op == "add" else g * -1.0)
            elif op == "mul":
                give(x, g * n.inputs[1])
                give(n.inputs[1], g * x)
            elif op == "div":
                give(x, g / n.inputs[1])
                give(n.inputs[1], g * n / n.inputs[1] * -1.0)
            elif op.endswith(" number"):
                give(x, g * d if op == "mul number" else g / d if op == "div number" else g)
            elif op == "weighted":
                give(x, g * d)
                uses.append((d, None, g * x))
            elif op == "product":
                give(x, g._with("product", x.width, detail=(d[0], not d[1])))
                uses.append((d[0], x, g))
            elif op == "pool":
                give(x, g.spread(d))
            elif op == "spread":
                give(x, g.pool(d))
            elif op == "concat":
                give(x, g.part(0, x.width))
                give(n.inputs[1], g.part(x.width, n.inputs[1].width))
            elif op == "part":
                give(x, g._with("padded", x.width, detail=(d, x.width - d - n.width)))
            elif op == "at":
                give(x, g.gather(d))
            elif op == "gather":
                give(x, g.at(d))
            elif op == "total":
                give(x, g.total(d))
            elif op == "keep":
                give(x, g)
            elif op not in ("fixed", "highest", "top"):
                raise ValueError(f"{op} has no adjoint")
        return grads, uses

    def release(self) -> None:
        if self.held:
            discard(SparkSession.active(), self.held)


class Recorded(Layer):
    """A layer that is a program: a function of a vertex tensor and of the weights by name. Its adjoint comes from the tape."""

    cuts = (True, True)

    def __init__(self, graph: Graph, width: int, weights: dict[str, np.ndarray], program: Callable[[Tensor, dict[str, Weight]], Tensor]):
        super().__init__()
        self.graph, self.width, self.weights, self.program, self.tape = graph, width, weights, program, None

    def forward(self, x, training=True):
        self.tape = Tape(self.graph, training)
        self.x = self.tape.input(x, self.width)
        self.y = self.program(self.x, {k: Weight(k, w) for k, w in self.weights.items()})
        return self.tape.vertices([self.y]).select("vid", F.col(self.y.name).alias("h"))

    def backward(self, g, wanted=True):
        tape = self.tape
        grads, uses = tape.gradients(self.y, tape.input(g, self.y.width))
        self.pending = {}
        for w, x, d in uses:
            rows = tape.rows([d] if x is None else [x, d])
            one = F.array(F.lit(1.0)) if x is None else F.col(x.name)
            pair = rows.select(one.alias("h"), F.col(d.name).alias("g"))
            # the weight of one row is listed as a column
            pair = pair.select(F.col("g").alias("h"), F.col("h").alias("g")) if x is None and self.weights[w.name].ndim == 1 else pair
            self.pending[w.name] = self.pending[w.name].union(pair) if w.name in self.pending else pair
        if not wanted:
            return None
        if self.x.id not in grads:
            return self.graph.vertices.select("vid", F.array_repeat(F.lit(0.0), self.width).alias("h"))
        gx = grads[self.x.id]
        return tape.vertices([gx]).select("vid", F.col(gx.name).alias("h"))

    def release(self):
        if self.tape:
            self.tape.release()


def attention(heads: int = 1) -> Callable[[Tensor, dict[str, Weight]], Tensor]:
    """Graph attention of several heads: each looks at its own part of h = x w, and their sums stand side by side."""

    def program(x: Tensor, w: dict[str, Weight]) -> Tensor:
        h = (x @ w["w"]).keep()
        size = h.width // heads
        score = ((h * w["al"]).pool(size).at("src") + (h * w["ar"]).pool(size).at("dst")).leaky()
        return (score.softmax().spread(size) * h.at("src")).gather()

    return program
