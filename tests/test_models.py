"""Gradients of whole models against central differences, equal forms of a model, and readers."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from graphloom.functions import nn
from graphloom.functions.nn import EPS, fixed_weight
from graphloom.functions.optim import Adam
from graphloom.operators import vectors
from graphloom.operators.graph import Graph
from graphloom.operators.messages import GatherExtreme, Scatter, norm_aggregate
from graphloom.plans import models, runner, training
from graphloom.plans.layers import Chain, Dropout, Elementwise, Gather, Linear, LogSoftmax, Recomputed, loss_gradient
from graphloom.sources import edge_files
from graphloom.sources.vertex_files import Config, read_numbered, read_vertices

EDGES = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 2), (3, 2), (1, 1), (0, 0), (3, 3)]


@pytest.fixture(scope="module")
def setup(spark):
    rng = np.random.default_rng(3)
    g = Graph(spark.range(4).withColumnRenamed("id", "vid"), spark.createDataFrame(EDGES, "src long, dst long"))
    x = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(4)], "vid long, h array<double>").cache()
    truth = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 0, 1)], "vid long, label long, mask int").cache()
    return g, x, truth


def loss(out, truth):
    h, y = {r["vid"]: r["h"] for r in out.collect()}, [r for r in truth.collect() if r["mask"] == 0]
    return -np.mean([h[r["vid"]][r["label"]] for r in y])


@pytest.mark.parametrize("name", ["gcn", "gcn_eager", "gat", "gat_recorded", "gat_heads", "gin", "commnet"])
def test_gradients(setup, name):
    g, x, truth = setup
    model = models.MODELS[name](g, [3, 4, 2] if name == "gat_heads" else [3, 2])
    out = model.forward(x)
    model.backward(loss_gradient(out, truth))
    grads = [{k: v.copy() for k, v in p.grads.items()} for p in model.layers() if p.weights]
    model.release()
    for p, grad in zip([p for p in model.layers() if p.weights], grads):
        for k, w in p.weights.items():
            at, e, both = (0,) * w.ndim, 1e-5, []
            for sign in (1, -1):
                w[at] += sign * e
                both.append(loss(model.forward(x, training=False), truth))
                w[at] -= sign * e
            assert np.isclose((both[0] - both[1]) / (2 * e), grad[k][at], atol=1e-5), (name, k)


def dense(spark, frame, key="vid"):
    return np.array([r["h"] for r in frame.orderBy(key).collect()])


def test_training_follows_numpy(spark, setup):
    """Two epochs of a GCN with batch norm beside the same steps on dense matrices."""
    g, x, truth = setup
    got = training.train(models.gcn(g, [3, 4, 2]), x, truth, 2).orderBy("epoch", "mask").collect()
    h, y, train = dense(spark, x), np.array([0, 1, 1, 0]), np.array([True, True, True, False])
    a = np.zeros((4, 4))
    for s, d in EDGES:
        a[d, s] = 1 / np.sqrt(sum(e[0] == s for e in EDGES) * sum(e[1] == d for e in EDGES))
    w = {0: fixed_weight(3, 4, 0), 1: fixed_weight(4, 2, 1)}
    adam = Adam()
    for epoch in range(2):
        z = a @ h
        z = (z - z.mean(0)) / np.sqrt(z.var(0) + EPS)
        u = z @ w[0]
        q = a @ np.maximum(u, 0)
        o = q @ w[1]
        p = np.exp(o - o.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for mask, rows in ((0, train), (1, ~train)):
            r = next(r for r in got if r["epoch"] == epoch and r["mask"] == mask)
            assert np.isclose(r["loss"], -np.log(p[rows, y[rows]]).mean()) and r["correct"] == (o.argmax(1) == y)[rows].sum()
        go = (p - np.eye(2)[y]) * train[:, None] / train.sum()
        gu = (a.T @ (go @ w[1].T)) * (u > 0)
        w = adam.update(w, {0: z.T @ gu, 1: q.T @ go})


def test_recomputed_and_elementwise_layers(spark, setup):
    g, x, truth = setup
    grads = []
    for wrap in (lambda c: c, Recomputed):
        inner = Chain(Gather(norm_aggregate(g, 3)), Linear(fixed_weight(3, 4)), Elementwise(F.tanh, lambda v: 1 - F.tanh(v) * F.tanh(v)), Dropout(0.1, 1))
        model = Chain(wrap(inner), Linear(fixed_weight(4, 2, 1)), LogSoftmax())
        model.backward(loss_gradient(model.forward(x), truth), wanted=False)
        grads.append([p.grads["w"] for p in model.learned()])
        model.release()
    assert all(np.allclose(p, q) for p, q in zip(*grads)) and any(np.abs(p).sum() > 0 for p in grads[0])


def test_wide_vectors_are_summed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WIDE", 4)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 10))
    m = spark.createDataFrame([(i % 3, v[i].tolist(), float(i)) for i in range(20)], "dst long, m array<double>, w double")
    got = {r["dst"]: r["h"] for r in vectors.sum_vectors(m, "dst", 10, weight=F.col("w")).collect()}
    assert all(np.allclose(got[k], sum(i * v[i] for i in range(20) if i % 3 == k)) for k in range(3))
    top = vectors.fold_vectors(m, None, 10, F.max).first()["h"]
    assert np.allclose(top, v.max(0))


def test_repeated_edges_take_a_gradient_once(spark):
    g = Graph(spark.range(2).withColumnRenamed("id", "vid"), spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "src long, dst long"))
    x = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vid long, h array<double>")
    op = GatherExtreme(g, 1)
    got = op.backward(Scatter(g, 1).forward(x), x).collect()
    assert sorted((r["src"], r["dst"], r["m"][0]) for r in got) == [(0, 1, 0.0), (0, 1, 2.0), (1, 0, 1.0)]


def test_numbered_files_and_bad_edge_files(spark, tmp_path):
    for name, lines in (("a", range(5)), ("b", range(5, 12)), ("c", range(12, 13))):
        (tmp_path / "lines" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "lines" / name).write_text("".join(f"{x},1\n" for x in lines))
    (tmp_path / "labels").write_text("".join(f"{i % 3}\n" for i in range(13)))
    (tmp_path / "train").write_text("0\n3\n")
    (tmp_path / "test").write_text("4\n")
    v = read_numbered(spark, str(tmp_path / "lines"), str(tmp_path / "labels"), {"train": str(tmp_path / "train"), "test": str(tmp_path / "test")}).orderBy("vid").collect()
    assert [(r["vid"], r["h"], r["label"], r["mask"]) for r in v] == [(i, [float(i), 1.0], i % 3, {0: 0, 3: 0, 4: 2}.get(i, 3)) for i in range(13)]
    with pytest.raises(Exception, match="2\\^32"):
        edge_files.write_binary(spark.createDataFrame([(1 << 32, 0)], "src long, dst long"), str(tmp_path / "big"))
    (tmp_path / "cut.bin").write_bytes(b"123456789")
    with pytest.raises(Exception, match="within a record"):
        edge_files.read_binary(spark, str(tmp_path / "cut.bin")).count()


def test_orders_of_a_layer_agree(setup):
    g, x, _ = setup
    rows = lambda m: np.array([r["h"] for r in m.forward(x, training=False).orderBy("vid").collect()])
    assert np.allclose(rows(models.gcn_planned(g, [3, 2])), rows(models.gcn(g, [3, 2])))


def test_binary_edges(spark, setup, tmp_path):
    g, _, _ = setup
    path = edge_files.write_binary(g.edges, str(tmp_path / "edges"))
    assert sorted(map(tuple, edge_files.read_binary(spark, path).collect())) == sorted(EDGES)


def test_text_sources(spark, tmp_path):
    (tmp_path / "f").write_text("1 0.5 2\n0 1 3\n")
    (tmp_path / "l").write_text("0 4\n1 2\n")
    (tmp_path / "m").write_text("1 val\n0 train\n")
    (tmp_path / "e").write_text("# note\n\n0 1\n1 0 2.5\n")
    v = read_vertices(spark, *(str(tmp_path / k) for k in "flm")).orderBy("vid").collect()
    assert [(r["h"], r["label"], r["mask"]) for r in v] == [([1.0, 3.0], 4, 0), ([0.5, 2.0], 2, 1)]
    assert sorted((r["src"], r["dst"], r["w"] or 0) for r in edge_files.convert_text(spark, str(tmp_path / "e")).collect()) == [(0, 1, 0), (1, 0, 2.5)]


def test_unknown_program(spark):
    with pytest.raises(ValueError, match="no program"):
        runner.run(spark, Config(algorithm="NONE"))


def test_config():
    c = Config.parse("ALGORITHM:GCNCPU\nVERTICES:10\nLAYERS:8-4-2\nFANOUT:5-10\nPROC_CUDA:1\nDECAY_RATE:0.97\nPROC_LOCAL:1\n")
    assert (c.algorithm, c.layers, c.fanout, c.decay_rate, c.proc_local, c.ignored) == ("GCNCPU", (8, 4, 2), (5, 10), 0.97, True, ("PROC_CUDA",))


def test_products_keep_null_vectors(spark):
    """A product per Arrow batch, in batches smaller than the frame, without pandas."""
    rng = np.random.default_rng(7)
    x, w = rng.normal(size=(50, 5)), rng.normal(size=(5, 3))
    rows = [(i, None if i % 7 == 3 else x[i].tolist()) for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = {r["vid"]: r["h"] for r in nn.linear(spark.createDataFrame(rows, "vid long, h array<double>"), w).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((got[i] is None) if h is None else np.allclose(got[i], x[i] @ w) for i, h in rows)
