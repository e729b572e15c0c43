"""The tape: gradients of programs beside hand-written adjoints, dense matrices and central differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.nn import fixed_weight
from graphloom.operators.graph import Graph
from graphloom.operators.messages import EdgeSoftmax
from graphloom.plans import models
from graphloom.plans.layers import LogSoftmax, loss_gradient
from graphloom.plans.tape import Recorded, Tape

EDGES = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 2), (3, 2), (1, 1), (0, 0), (3, 3), (0, 2)]


@pytest.fixture(scope="module")
def g(spark):
    return Graph(spark.range(5).withColumnRenamed("id", "vid"), spark.createDataFrame(EDGES, "src long, dst long"))


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, h array<double>")


def dense(df, col="h"):
    return np.array([r[col] for r in df.orderBy("vid").collect()])


def test_recorded_attention_has_the_gradients_of_the_layer(spark, g):
    rng = np.random.default_rng(4)
    x = frame(spark, rng.normal(size=(5, 3)))
    truth = spark.createDataFrame([(i, i % 2, int(i == 4)) for i in range(5)], "vid long, label long, mask int")
    grads, inputs = [], []
    for build in (models.gat, models.gat_recorded):
        model = build(g, [3, 4, 2])
        out = model.forward(x)
        inputs.append(dense(model.backward(loss_gradient(out, truth))))
        grads.append({k: v for i, p in enumerate(p for p in model.layers() if p.weights) for k, v in p.grads.items() if not k.startswith("x")} if build is models.gat_recorded else None)
        if build is models.gat:
            learned = [p.grads for p in model.layers() if p.weights]
            last = {**learned[-2], **learned[-1]}
        model.release()
    assert np.allclose(*inputs) and np.abs(inputs[0]).sum() > 0
    assert all(np.allclose(last[k], grads[1][k]) for k in ("w", "al", "ar"))


def all_operations(x, w):
    """Every operation once, inputs used more than once, a weight used twice, edges and vertices mixed."""
    h = (x @ w["a"]).apply("tanh").keep()
    s, d = h.at("src"), h.at("dst")
    both = (s * d - s / (d * d + 1.5)).concat(s.part(1, 2))
    gate = (both.pool(both.width) * 0.1).apply("sigmoid")
    m = both * gate + both.exp() * 0.01
    a = (s @ w["b"]).leaky().softmax()
    back = (m * a.pool(2)).gather("src")
    y = (a.spread(3) * m).gather() + back * w["c"]
    return ((y @ w["d"]).relu() + (x * w["e"]) @ w["a"]) / 2.0


def test_every_operation_by_central_differences(spark, g):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5, 3))
    weights = {"a": rng.normal(size=(3, 4)), "b": rng.normal(size=(4, 2)), "c": rng.normal(size=(1, 6)), "d": rng.normal(size=(6, 4)), "e": rng.normal(size=3)}
    seed = rng.normal(size=(5, 4))
    layer = Recorded(g, 3, weights, all_operations)
    value = lambda: float((dense(layer.forward(frame(spark, x), training=False)) * seed).sum())
    layer.forward(frame(spark, x))
    gx, grads = dense(layer.backward(frame(spark, seed))), {k: v.copy() for k, v in layer.grads.items()}
    layer.release()
    for k, at in (("a", (0, 1)), ("b", (2, 1)), ("c", (0, 3)), ("d", (5, 0)), ("e", (1,)), ("x", (0, 2)), ("x", (3, 0))):
        own, e, ends = x if k == "x" else weights[k], 1e-5, []
        for sign in (1, -1):
            own[at] += sign * e
            ends.append(value())
            own[at] -= sign * e
        assert np.isclose((ends[0] - ends[1]) / (2 * e), (gx if k == "x" else grads[k])[at], rtol=1e-4, atol=1e-6), (k, at)


def test_large_products_equal_small_ones(spark, g, monkeypatch):
    from graphloom.plans import tape

    x, out = frame(spark, np.arange(15).reshape(5, 3)), []
    for small in (256, 1):
        monkeypatch.setattr(tape, "SMALL", small)
        t = Tape(g)
        y = t.input(x, 3) @ tape.Weight("w", fixed_weight(3, 4))
        out.append(dense(t.vertices([y]), y.name))
    assert np.allclose(*out)


def test_programs_of_other_widths_are_refused(spark, g):
    t = Tape(g)
    x = t.input(frame(spark, np.ones((5, 3))), 3)
    for wrong in (lambda: x + x.part(0, 2), lambda: x + x.at("src")):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("width", [1, 8])
def test_softmax_of_columns(spark, g, width):
    """Each column by itself in numpy, and the adjoint by central differences."""
    rng = np.random.default_rng(1)
    own = sorted(set(EDGES))
    s, grad = rng.normal(size=(len(own), width)) * 3, rng.normal(size=(len(own), width))
    table = lambda v, name: spark.createDataFrame([(*e, r.tolist()) for e, r in zip(own, v)], f"src long, dst long, {name} array<double>")

    def soft(v):
        out = np.empty_like(v)
        for d in {e[1] for e in own}:
            rows = [i for i, e in enumerate(own) if e[1] == d]
            x = np.exp(v[rows] - v[rows].max(0))
            out[rows] = x / x.sum(0)
        return out

    op = EdgeSoftmax(width)
    a = op.forward(table(s, "s"))
    got = {(r["src"], r["dst"]): r["a"] for r in a.collect()}
    assert np.allclose([got[e] for e in own], soft(s))
    back = {(r["src"], r["dst"]): r["s"] for r in op.backward(a.join(table(grad, "g"), ["src", "dst"])).collect()}
    for i, j in ((0, 0), (3, width - 1), (7, width // 2)):
        step = np.zeros_like(s)
        step[i, j] = 1e-6
        want = ((soft(s + step) - soft(s - step)) * grad).sum() / 2e-6
        assert np.isclose(back[own[i]][j], want, atol=1e-6)
