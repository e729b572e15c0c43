"""Hubs, wide vectors, sums of large gradients, partitions, resumed training and files of weighted and numbered graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.nn import fixed_weight
from graphloom.functions.optim import SGD, Adam
from graphloom.operators import messages as M
from graphloom.operators.graph import Graph
from graphloom.operators.partition import edge_cut, partition
from graphloom.plans import layers, models, training
from graphloom.sources import edge_files, generators
from graphloom.sources.vertex_files import read_vertices


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, h array<double>")


def test_parts_keep_communities_together(spark):
    """Six communities of 30 with few edges between them and ids that say nothing of them, in three parts."""
    rng = np.random.default_rng(2)
    name = rng.permutation(180).tolist()
    pairs = [(i, j) for c in range(6) for i in range(30 * c, 30 * c + 30) for j in rng.integers(30 * c, 30 * c + 30, 8).tolist()]
    pairs += [(int(a), int(b)) for a, b in rng.integers(0, 180, (60, 2))]
    rows = [(name[a], name[b]) for a, b in pairs]
    v = spark.range(180).withColumnRenamed("id", "vid")
    g = Graph(v, spark.createDataFrame(rows, "src long, dst long"))
    parts = partition(g, 3)
    got = {r["vid"]: r["part"] for r in parts.collect()}
    sizes = np.bincount(list(got.values()), minlength=3)
    assert len(got) == 180 and sizes.max() <= 66 and sizes.sum() == 180
    cut = edge_cut(g, parts).first()["cut"]
    by = lambda c: edge_cut(g, v.select("vid", c.alias("part"))).first()["cut"]
    hashed, ranges = by(F.pmod(F.xxhash64("vid"), F.lit(3))), by(F.floor(F.col("vid") / 60))
    assert cut < 0.5 * min(hashed, ranges), (cut, hashed, ranges)
    # the same whatever the order and the partitions of the input
    rng.shuffle(rows)
    again = partition(Graph(v.repartition(3), spark.createDataFrame(rows, "src long, dst long").repartition(5)), 3)
    assert {r["vid"]: r["part"] for r in again.collect()} == got


def test_parts_of_odd_graphs(spark):
    v = spark.range(5).withColumnRenamed("id", "vid")
    g = Graph(v, spark.createDataFrame([(0, 0)], "src long, dst long"))
    assert partition(g, 2, balance=1.3).count() == 5
    with pytest.raises(ValueError, match="fit"):
        partition(g, 2, balance=1.1)


def test_hubs_are_dealt_out(spark):
    """A star: the hub gives to half of the vertices and takes from the other half."""
    n = 4000
    edges = [(0, i) for i in range(1, n // 2)] + [(i, 0) for i in range(n // 2, n)] + [(i, i - 1) for i in range(1, n)]
    g = Graph(spark.range(n).withColumnRenamed("id", "vid"), spark.createDataFrame(edges, "src long, dst long").repartition(8))
    x = np.random.default_rng(0).normal(size=(n, 3))
    op, plain = M.BalancedAggregate(g, 3, g.norm_weights), M.norm_aggregate(g, 3)
    assert [r["src"] for r in op.hot("src").collect()] == [0] and [r["dst"] for r in op.hot("dst").collect()] == [0]
    for run in ("forward", "backward"):
        a, b = (np.array([r["h"] for r in getattr(o, run)(frame(spark, x)).orderBy("vid").collect()]) for o in (op, plain))
        assert np.allclose(a, b)
    # the hub's edges stay where they are: no partition of the messages holds more than 4 times the median
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        weights = g.weights(lambda a, b: F.lit(1.0))
        held = M.BalancedAggregate(g, 3, weights).messages(frame(spark, x), "src").groupBy(F.spark_partition_id()).count().collect()
        counts = sorted(r["count"] for r in held)
        assert sum(counts) == len(edges) and counts[-1] <= 4 * counts[len(counts) // 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("kind", ["max", "min"])
def test_records_of_wide_vectors(spark, kind):
    rng = np.random.default_rng(1)
    width, edges = 3703, [(s, d) for s in range(6) for d in range(2) if (s + d) % 5]
    m = {e: rng.integers(-3, 4, width).astype(float) for e in edges}
    g = Graph(spark.range(6).withColumnRenamed("id", "vid"), spark.createDataFrame(edges, "src long, dst long"))
    got = M.GatherExtreme(g, width, kind).sources(spark.createDataFrame([(*e, v.tolist()) for e, v in m.items()], "src long, dst long, m array<double>")).collect()
    for r in got:
        src = [s for s, d in edges if d == r["dst"]]
        table = np.array([m[s, r["dst"]] for s in src])
        best = table.argmax(0) if kind == "max" else table.argmin(0)
        assert r["from"] == [src[i] for i in best]
    assert len(got) == 2


def test_gradients_of_wide_weights_are_summed_as_arrays(spark):
    rng = np.random.default_rng(3)
    h, g = rng.normal(size=(40, 3703)), rng.normal(size=(40, 16))
    rows = spark.createDataFrame([(h[i].tolist(), g[i].tolist()) for i in range(40)], "h array<double>, g array<double>").repartition(20)
    small = spark.createDataFrame([([1.0, 2.0], [3.0])], "h array<double>, g array<double>")
    wide, thin, none = layers.outer_sums([(rows, 3703, 16), (small, 2, 1), (small.limit(0), 2, 1)])
    assert np.allclose(wide, h.T @ g) and thin.tolist() == [[3.0], [6.0]] and not none.any()
    partial = layers.tree_sum(rows.select(F.lit(0).alias("tag"), F.col("g").alias("s")), fan=3).collect()
    assert len(partial) <= 3 and np.allclose(sum(np.array(r["s"]) for r in partial), g.sum(0))


def test_batch_norm_of_wide_vectors(spark):
    """Statistics as one row give what numbers in the plan give, forward and backward."""
    rng = np.random.default_rng(6)
    x, g = rng.normal(size=(7, 300)), rng.normal(size=(7, 300))
    layer = layers.BatchNorm(300)
    z = np.array([r["h"] for r in layer.forward(frame(spark, x)).orderBy("vid").collect()])
    want = (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5)
    assert np.allclose(z, want)
    back = np.array([r["h"] for r in layer.backward(frame(spark, g)).orderBy("vid").collect()])
    assert np.allclose(back, (g - g.mean(0) - want * (g * want).mean(0)) / np.sqrt(x.var(0) + 1e-5))
    assert len(layer.z._jdf.queryExecution().optimizedPlan().toString()) < 5000


@pytest.mark.parametrize("make", [Adam, SGD])
def test_training_goes_on_where_it_stopped(spark, tmp_path, make):
    g = Graph(spark.range(4).withColumnRenamed("id", "vid"), spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 2), *((i, i) for i in range(4))], "src long, dst long"))
    x = frame(spark, np.random.default_rng(3).normal(size=(4, 3)))
    truth = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 0, 1)], "vid long, label long, mask int")
    build = lambda: models.gcn(g, [3, 4, 2], rate=0.3)
    rows = lambda df: [(r["epoch"], r["mask"], r["correct"], round(r["loss"], 9)) for r in df.orderBy("epoch", "mask").collect()]
    whole = build()
    want = rows(training.train(whole, x, truth, 4, make()))
    where = str(tmp_path / "state")
    first = rows(training.train(build(), x, truth, 2, make(), state=where))
    # an epoch whose table isn't complete doesn't count
    (tmp_path / "state" / "epoch=2").mkdir()
    model = build()
    rest = rows(training.train(model, x, truth, 4, make(), state=where))
    assert first + rest == want
    for a, b in zip(whole.learned(), model.learned()):
        assert all(np.allclose(a.weights[k], b.weights[k]) for k in a.weights)
    assert training.train(build(), x, truth, 4, make(), state=where).count() == 0


def test_weighted_records(spark, tmp_path):
    rows = [(1, 2, 0.5), (4294967295, 0, -3.25), (1, 2, float("inf"))]
    path = edge_files.write_binary(spark.createDataFrame(rows, "src long, dst long, w double"), str(tmp_path / "w"), weighted=True)
    assert sorted(map(tuple, edge_files.read_binary(spark, path, weighted=True).collect())) == sorted(rows)
    assert sum(f.stat().st_size for f in (tmp_path / "w").iterdir()) == 36
    # a second job adds to the folder and takes nothing of other jobs away
    (tmp_path / "w" / "_tasks-other").mkdir()
    edge_files.write_binary(spark.createDataFrame([(7, 8, 1.0)], "src long, dst long, w double"), path, weighted=True)
    assert edge_files.read_binary(spark, path, weighted=True).count() == 4 and (tmp_path / "w" / "_tasks-other").exists()
    with pytest.raises(Exception, match="within a record"):
        (tmp_path / "cut").write_bytes(b"x" * 20)
        edge_files.read_binary(spark, str(tmp_path / "cut"), weighted=True).count()
    edge_files.write_binary(spark.createDataFrame([], "src long, dst long"), str(tmp_path / "none"))
    text = tmp_path / "t"
    text.write_text("0 1 2.5\n1 0 0.5\n")
    path = edge_files.write_binary(edge_files.convert_text(spark, str(text)), str(tmp_path / "c"), weighted=True)
    assert sorted(map(tuple, edge_files.read_binary(spark, path, weighted=True).collect())) == [(0, 1, 2.5), (1, 0, 0.5)]


def test_numbered_flow(spark, tmp_path):
    for name, lines in {"e": "0,1\n1,0\n2,2\n 1, 2\n\n", "f": "1,2\n3,4\n5,6.5\n7,8\n", "l": "0\n1\n0\n2\n", "tr": "3\n0\n", "va": "1\n"}.items():
        (tmp_path / name).write_text(lines)
    edge_files.prepare_numbered(spark, *(str(tmp_path / k) for k in "efl"), {"train": str(tmp_path / "tr"), "val": str(tmp_path / "va")}, str(tmp_path / "out"))
    e = sorted(map(tuple, edge_files.read_binary(spark, f"{tmp_path}/out/edges").collect()))
    assert e == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    v = read_vertices(spark, *(f"{tmp_path}/out/{k}" for k in ("features", "labels", "masks"))).orderBy("vid").collect()
    assert [(r["vid"], r["h"], r["label"], r["mask"]) for r in v] == [(0, [1, 2], 0, 0), (1, [3, 4], 1, 1), (2, [5, 6.5], 0, 3), (3, [7, 8], 2, 0)]


@pytest.mark.parametrize("n, parts", [(0, 3), (2, 3), (3, 3), (7, 3), (23, 2), (600, 2), (1541, 3)])
def test_cliques(spark, n, parts):
    size = n // parts
    g = generators.cliques(spark, n, parts)
    got = g.edges.collect()
    assert g.vertices.count() == size * parts and g.edges.columns == ["src", "dst"]
    want = {(i, j) for i in range(size * parts) for j in range(i // size * size, i // size * size + size) if i != j}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_cliques_take_little_space(spark, tmp_path):
    """Written out, an edge takes about a bit, however large its group is, and tasks stay small."""
    few = generators.cliques(spark, 5200, 1).edges.filter("src < 512")
    few.write.parquet(str(tmp_path / "e"))
    assert few.count() == 512 * 5199
    assert sum(f.stat().st_size for f in (tmp_path / "e").glob("*.parquet")) * 8 < 2 * 512 * 5199
    assert generators.cliques(spark, 600_000, 10).edges.rdd.getNumPartitions() > 2000
