"""A graph of five vertices with a loop, a vertex without in-edges and an isolated one, against worked-out values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import nn
from graphloom.functions.optim import SGD, Adam
from graphloom.operators import messages as M
from graphloom.operators import sampling
from graphloom.operators.graph import Graph, partition_bounds

EDGES = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 2), (3, 2)]
X = np.array([[1, -2], [3, 0], [-1, 4], [2, 2], [7, 7]], float)


@pytest.fixture(scope="module")
def g(spark):
    return Graph(spark.range(5).withColumnRenamed("id", "vid"), spark.createDataFrame(EDGES, "src long, dst long"))


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, h array<double>")


def dense(df):
    return np.array([r["h"] for r in df.orderBy("vid").collect()])


@pytest.fixture(scope="module")
def x(spark):
    return frame(spark, X)


def test_degrees_weights_and_offsets(g):
    assert [r["degree"] for r in g.degrees("src").orderBy("vid").collect()] == [2, 1, 2, 1, 0]
    assert [r["degree"] for r in g.degrees("dst").orderBy("vid").collect()] == [1, 1, 4, 0, 0]
    w = {(r["src"], r["dst"]): r["w"] for r in g.norm_weights.collect()}
    assert np.allclose([w[e] for e in EDGES], [0.707107, 0.353553, 0.5, 0.707107, 0.353553, 0.5], atol=1e-6)
    assert [r["start"] for r in g.offsets("dst").orderBy("vid").collect()] == [0, 1, 2, 6, 6]
    assert [r["start"] for r in g.offsets("src").orderBy("vid").collect()] == [0, 2, 3, 5, 6]
    assert {r["vid"]: r["slot"] for r in g.mirrors().collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_aggregates(spark, g, x):
    agg = M.norm_aggregate(g, 2)
    assert np.allclose(dense(agg.forward(x)), [[-0.707107, 2.828427], [0.707107, -1.414214], [2.5, 1.707107], [0, 0], [0, 0]], atol=1e-6)
    ones = frame(spark, np.ones((5, 2)))
    assert np.allclose(dense(agg.backward(ones))[:, 0], [1.06066, 0.5, 1.06066, 0.5, 0], atol=1e-5)
    m = M.Scatter(g, 2).forward(x)
    assert np.allclose(dense(M.GatherSum(g, 2).forward(m)), [[-1, 4], [1, -2], [5, 4], [0, 0], [0, 0]])
    assert np.allclose(dense(M.GatherExtreme(g, 2, "min").forward(m)), [[-1, 4], [1, -2], [-1, -2], [0, 0], [0, 0]])
    assert np.allclose(dense(M.GatherExtreme(g, 2, "max", True).forward(m)), [[0, 4], [1, 0], [3, 4], [0, 0], [0, 0]])


def test_softmax_and_learned_weights(spark, g, x):
    s = M.Scatter(g, 2).forward(x).select("src", "dst", F.col("m")[0].alias("s"))
    a = M.EdgeSoftmax().forward(s)
    got = {(r["src"], r["dst"]): r["a"] for r in a.collect()}
    assert np.allclose([got[e] for e in EDGES], [1, 0.088947, 0.657233, 1, 0.012038, 0.241783], atol=1e-6)
    grads = spark.createDataFrame([(*e, float(i + 1)) for i, e in enumerate(EDGES)], "src long, dst long, g double")
    back = {(r["src"], r["dst"]): r["s"] for r in M.EdgeSoftmax().backward(a.join(grads, ["src", "dst"])).collect()}
    assert np.allclose([back[e] for e in EDGES], [0, -0.147694, -0.434087, 0, 0.016125, 0.565656], atol=1e-6)
    op = M.Aggregate(g, 2, a.withColumnRenamed("a", "w"))
    assert np.allclose(dense(op.forward(x))[2], [2.532173, 0.353822], atol=1e-6)
    gw = {(r["src"], r["dst"]): r["w"] for r in op.backward_weights(x, frame(spark, np.ones((5, 2)))).collect()}
    assert np.allclose([gw[e] for e in EDGES], [-1, -1, 3, 3, 3, 4])


@pytest.mark.parametrize("ends", ["src", "dst", "both"])
def test_adjoint_of_scatter(spark, g, x, ends):
    op, width = M.Scatter(g, 2, ends), 4 if ends == "both" else 2
    rng = np.random.default_rng(0)
    grad = {e: rng.normal(size=width) for e in EDGES}
    m = {(r["src"], r["dst"]): np.array(r["m"]) for r in op.forward(x).collect()}
    back = dense(op.backward(spark.createDataFrame([(*e, v.tolist()) for e, v in grad.items()], "src long, dst long, m array<double>")))
    assert np.isclose(sum(m[e] @ grad[e] for e in EDGES), (back * X).sum())


def test_dense_layers(spark, x):
    z = dense(nn.batch_norm(x, 2))
    assert np.allclose(z[0], [-0.527644, -1.344387], atol=1e-6)
    logp = x.select("vid", nn.log_softmax(F.col("h")).alias("h"))
    assert np.allclose(dense(logp)[2], [-5.006715, -0.006715], atol=1e-6)
    labelled = logp.join(spark.createDataFrame([(i, y) for i, y in enumerate([0, 0, 1, 1, 0])], "vid long, label long"), "vid")
    assert np.isclose(nn.nll(labelled.filter("vid in (0, 3)")).first()["loss"], 0.370867, atol=1e-6)
    assert [r["a"] for r in x.select("vid", nn.argmax(F.col("h")).alias("a")).orderBy("vid").collect()] == [0, 0, 1, 0, 0]


def test_optimisers():
    for compat, want in ((False, [0.99, 0.98, 0.97]), (True, [0.96837723, 0.95272321, 0.93847094])):
        adam, w = Adam(compat=compat), {"w": np.array([1.0])}
        for v in want:
            w = adam.update(w, {"w": np.array([0.5])})
            assert np.isclose(w["w"][0], v, atol=1e-6)
    assert np.isclose(SGD().update({"w": np.array([1.0])}, {"w": np.array([0.5])})["w"][0], 0.995 * 0.9999)


def test_sampling(spark, g):
    n = {r["dst"]: r["count"] for r in sampling.sample_neighbours(g.edges, 2).groupBy("dst").count().collect()}
    assert n == {0: 1, 1: 1, 2: 2}
    batches = sampling.seed_batches(g.vertices, 2).orderBy("vid").collect()
    assert [r["batch_id"] for r in batches] == [0, 0, 1, 1, 2]


def test_partition_bounds(g):
    b = partition_bounds(g, 2, page=1, alpha=0.0)
    assert b[0] == 0 and b[-1] == 5 and b == sorted(b)
