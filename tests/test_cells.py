import numpy as np
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.messages import Aggregate
from graphloom.plans import queries
from graphloom.plans.layers import Attention


def small(spark, n=40):
    rng = np.random.default_rng(6)
    e = [(int(a), int(b)) for a, b in rng.integers(0, n - 3, (150, 2))]
    g = Graph(spark.createDataFrame([(i,) for i in range(n)], "vid long"), spark.createDataFrame([*e, e[0], (None, 1)], "src long, dst long"))
    x = {i: rng.normal(size=3) for i in range(n)}
    return g, [*e, e[0]], x, spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vid long, h array<double>")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_weight_gradients_carry_no_vector_with_an_edge(spark):
    g, e, x, frame = small(spark)
    out = Aggregate(g, 3).backward_weights(frame, frame)
    got = sorted((r["src"], r["dst"], round(r["w"], 9)) for r in out.collect())
    assert got == sorted((a, b, round(float(x[a] @ x[b]), 9)) for a, b in e)
    assert "Join" not in plan(out)


def test_attention_carries_no_vector_with_an_edge(spark):
    g, e, x, frame = small(spark)
    al, ar = np.array([0.3, -1.0, 0.7]), np.array([1.1, 0.2, -0.4])
    layer = Attention(g, al, ar)
    out = layer.forward(frame, training=False)
    want = {}
    for v in x:
        src = [a for a, b in e if b == v]
        z = np.array([x[a] @ al + x[v] @ ar for a in src])
        w = np.exp(np.where(z > 0, z, 0.2 * z))
        want[v] = sum(k * x[a] for k, a in zip(w / w.sum(), src)) if src else np.zeros(3)
    assert all(np.allclose(r["h"], want[r["vid"]]) for r in out.collect()) and out.count() == len(x)
    # the only join is that with the vertices
    assert plan(out).count("Join") == 1


def test_copied_features_are_rounded_by_vertex(spark):
    rows = plan(queries.QUERIES["scatter_src_dst"](spark, "/root/testdata/sf0.001"))
    assert "round(" in rows and "round(" not in rows[: rows.index("Generate")]
