"""Sampled blocks and training on them, beside dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.nn import fixed_weight
from graphloom.functions.optim import Adam
from graphloom.operators.blocks import BlockAggregate, numbered_seeds, sample_blocks, sources_of
from graphloom.operators.graph import Graph
from graphloom.plans import runner, sampled
from graphloom.sources.vertex_files import Config

N = 12


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, N, (60, 2))] + [(i, i) for i in range(N)] + [(0, 1), (0, 1)]
    g = Graph(spark.range(N).withColumnRenamed("id", "vid"), spark.createDataFrame(edges, "src long, dst long").cache())
    x = rng.normal(size=(N, 3))
    y = np.arange(N) % 3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid long, h array<double>").cache()
    truth = spark.createDataFrame([(i, int(y[i]), [0, 0, 1, 2][i % 4]) for i in range(N)], "vid long, label long, mask int").cache()
    return g, edges, x, y, frame, truth


def batches_of(spark):
    return spark.createDataFrame([(0, 5), (0, 1), (0, 9), (1, 4), (1, 0)], "batch_id long, vid long")


def test_blocks_are_bijections_and_chain(spark, world):
    g, edges, *_ = world
    batches = batches_of(spark)
    rows = sample_blocks(g, batches, [2, 3]).collect()
    seeds = {(r["batch_id"], r["local"]): r["vid"] for r in numbered_seeds(batches).collect()}
    assert seeds == {(0, 0): 1, (0, 1): 5, (0, 2): 9, (1, 0): 0, (1, 1): 4}
    for b in (0, 1):
        before = {k[1]: v for k, v in seeds.items() if k[0] == b}
        for hop, fanout in ((0, 2), (1, 3)):
            own = [r for r in rows if r["batch_id"] == b and r["hop"] == hop]
            assert {r["dst_local"]: r["dst"] for r in own} == before
            for local, vid in before.items():
                assert sum(r["dst_local"] == local for r in own) == min(fanout, sum(d == vid for _, d in edges))
            before = {r["src_local"]: r["src"] for r in own}
            assert sorted(before) == list(range(len(set(before.values())))) and len({r["src"] for r in own}) == len(before)
    out = {v: sum(s == v for s, _ in edges) for v in range(N)}
    into = {v: sum(d == v for _, d in edges) for v in range(N)}
    assert all(np.isclose(r["w"], 1 / np.sqrt(out[r["src"]] * into[r["dst"]])) for r in rows)


def matrices(rows, batch, names, hops):
    """A dense matrix for each hop, from its sources to its destinations, both by vertex."""
    out = []
    for hop in range(hops):
        a = np.zeros((N, N))
        for r in rows:
            if r["batch_id"] == batch and r["hop"] == hop:
                a[r["dst"], r["src"]] += r["w"]
        out.append(a)
    return out


def test_block_aggregate_and_adjoint(spark, world):
    g, _, x, _, frame, _ = world
    batches = batches_of(spark)
    blocks = sample_blocks(g, batches, [2, 3]).cache()
    rows = blocks.collect()
    for hop in (0, 1):
        op = BlockAggregate(blocks, batches, hop, 3)
        into = sources_of(blocks, hop).cache()
        y = op.forward(into.join(frame, "vid").select("batch_id", "local", "h")).collect()
        back = {(r["batch_id"], r["local"]): np.array(r["h"]) for r in op.backward(op.forward(into.join(frame, "vid").select("batch_id", "local", "h"))).collect()}
        to = numbered_seeds(batches) if not hop else sources_of(blocks, 0)
        named = {(r["batch_id"], r["local"]): r["vid"] for r in to.collect()}
        for b in (0, 1):
            a = matrices(rows, b, None, 2)[hop]
            assert all(np.allclose(r["h"], (a @ x)[named[b, r["local"]]]) for r in y if r["batch_id"] == b)
            mine = np.isin(np.arange(N), [v for (bb, _), v in named.items() if bb == b])[:, None]
            want = a.T @ ((a @ x) * mine)
            assert all(np.allclose(back[b, r["local"]], want[r["vid"]]) for r in into.collect() if r["batch_id"] == b)


@pytest.mark.parametrize("rate", [0.0, 0.5])
def test_one_update_follows_numpy(spark, world, rate):
    """Log-probabilities and gradients of both batches, two layers by hop, beside dense matrices."""
    g, _, x, y, frame, truth = world
    batches = batches_of(spark)
    blocks = sample_blocks(g, batches, [2, 3]).cache()
    rows, w = blocks.collect(), [fixed_weight(3, 4), fixed_weight(4, 3, 1)]
    packed = sampled.pack(blocks, batches, frame, truth, 2).cache()
    got = {r["batch_id"]: r for r in sampled.batch_gradients(packed, w, rate, step=1).collect()}
    for b, seeds in ((0, [1, 5, 9]), (1, [0, 4])):
        a0, a1 = matrices(rows, b, None, 2)
        keep = sampled.kept(np.arange(N), 4, rate, 31 + 17)
        z = (y1 := a1 @ x) @ w[0]
        q = a0 @ (np.maximum(z, 0) * keep)
        o = (q @ w[1])[seeds]
        p = np.exp(o - o.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        go = np.zeros((N, 3))
        go[seeds] = (p - np.eye(3)[y[seeds]]) / len(seeds)
        gz = (a0.T @ (go @ w[1].T)) * keep * (z > 0)
        want = [y1.T @ gz, q.T @ go]
        assert all(np.allclose(u, v) for u, v in zip(sampled.unpack(got[b]["grads"], [(3, 4), (4, 3)]), want))
        assert np.isclose(got[b]["loss"], -np.log(p[np.arange(len(seeds)), y[seeds]]).sum()) and got[b]["correct"] == (o.argmax(1) == y[seeds]).sum()
        if not rate:
            out = {r["vid"]: r["h"] for r in sampled.outputs(packed, w).filter(F.col("batch_id") == b).collect()}
            assert all(np.allclose(out[v], np.log(p[i])) for i, v in enumerate(seeds))


def test_sampled_training(spark, world):
    """Fanouts beyond the number of layers are ignored; masks 1 and 2 are measured without updates; two workers' gradients are one update."""
    g, _, _, _, frame, truth = world
    run = lambda **k: [tuple(r) for r in sampled.train_sampled(g, frame, truth, [3, 4, 3], 2, [2, 3, 9], 2, **k).collect()]
    rows = run()
    assert rows == [tuple(r) for r in sampled.train_sampled(g, frame, truth, [3, 4, 3], 2, [2, 3], 2).collect()]
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(e, b, m, n) for e in (0, 1) for b, m, n in ((0, 0, 2), (1, 0, 2), (2, 0, 2), (None, 1, 3), (None, 2, 3))]
    # all three batches in one update: Adam by hand
    batches = sampled.seed_batches(truth.filter("mask = 0").select("vid"), 2)
    w = [fixed_weight(3, 4), fixed_weight(4, 3, 1)]
    packed = sampled.pack(sample_blocks(g, batches, [2, 3]), batches, frame, truth, 2)
    grads = sampled.unpack(sum(np.array(r["grads"]) for r in sampled.batch_gradients(packed, w, n=6).collect()), [(3, 4), (4, 3)])
    moved = Adam().update(dict(enumerate(w)), dict(enumerate(grads)))
    second = sampled.pack(sample_blocks(g, batches, [2, 3], seed=2), batches, frame, truth, 2)
    want = [(r["batch_id"], r["n"], r["correct"], round(r["loss"] / r["n"], 9)) for r in sampled.batch_gradients(second, [moved[0], moved[1]]).orderBy("batch_id").collect()]
    assert [(r[1], r[3], r[4], round(r[6], 9)) for r in run(workers=3) if r[0] == 1 and r[2] == 0] == want
    with pytest.raises(ValueError, match="fanouts"):
        sampled.train_sampled(g, frame, truth, [3, 4, 3], 2, [2], 1)


def test_sampled_program_runs_from_files(spark, world, tmp_path):
    g, edges, x, y, *_ = world
    np.array(edges, "<u4").tofile(tmp_path / "e")
    (tmp_path / "f").write_text("".join(f"{i} {' '.join(map(str, v))}\n" for i, v in enumerate(x)))
    (tmp_path / "l").write_text("".join(f"{i} {v}\n" for i, v in enumerate(y)))
    lines = f"ALGORITHM:GCNSAMPLESINGLE\nVERTICES:{N}\nLAYERS:3-4-3\nFANOUT:2-3-3\nBATCH_SIZE:3\nEPOCHS:1\nDROP_RATE:0.2\nEDGE_FILE:{tmp_path}/e\nFEATURE_FILE:{tmp_path}/f\nLABEL_FILE:{tmp_path}/l\n"
    rows = runner.run(spark, Config.parse(lines)).collect()
    assert sorted((r["mask"], r["n"]) for r in rows) == [(0, 1), (0, 3), (1, 4), (2, 4)]


def test_jobs_of_sampled_training_dont_grow_with_its_updates(spark):
    rng = np.random.default_rng(4)
    ids = list(range(30))
    g = Graph(spark.createDataFrame([(i,) for i in ids], "vid long"), spark.createDataFrame([(i, j) for i in ids for j in (i, (i * 7 + 3) % 30)], "src long, dst long"))
    x = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in ids], "vid long, h array<double>")
    truth = spark.createDataFrame([(i, i % 3, i % 3) for i in ids], "vid long, label long, mask int")
    jobs = []
    for size in (1, 5):
        spark.sparkContext.setJobGroup(f"size {size}", "")
        rows = sampled.train_sampled(g, x, truth, [3, 4, 3], size, [2, 2], 1).collect()
        assert [r["batch"] for r in rows if r["mask"] == 0] == list(range(10 // size)) and {r["mask"] for r in rows} == {0, 1, 2}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"size {size}")))
    assert abs(jobs[0] - jobs[1]) <= 4
