"""The query registry: each operator over the driver's tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nn
from ..functions.optim import SGD, Adam
from ..operators import messages as M
from ..operators import sampling
from ..operators.blocks import BlockAggregate, numbered_seeds, sample_blocks, sources_of
from ..operators.graph import Graph, owner_of, partition_bounds
from ..operators.partition import partition
from ..operators.vectors import fold_vectors, scale, to_long
from ..sources import generators
from ..sources import tables as T
from ..sources.edge_files import prepare_numbered, read_binary, write_binary
from ..sources.shared import new_path
from ..sources.vertex_files import Config, read_vertices, write_vertices
from . import models, runner, sampled, training
from .layers import Chain, Linear, LogSoftmax

W64 = T.WIDTH
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the graph: n vertices, edges e0 and et (plain), e (with loops), degrees, weights, features f.
PREFIX = """
WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id AS vid, CAST(label AS BIGINT) AS label, CAST(vec_id % 3 AS INTEGER) AS mask FROM embeddings),
e0 AS (SELECT DISTINCT o_custkey % n AS src, o_orderkey % n AS dst FROM orders, n),
e AS (SELECT src, dst FROM e0 WHERE src <> dst UNION ALL SELECT vid, vid FROM v),
et AS (SELECT src, dst FROM e0),
od AS (SELECT src, count(*) AS od FROM e GROUP BY src), idg AS (SELECT dst, count(*) AS idg FROM e GROUP BY dst),
w AS (SELECT e.src, e.dst, 1 / (sqrt(od) * sqrt(idg)) AS w FROM e JOIN od ON od.src = e.src JOIN idg ON idg.dst = e.dst),
f AS (SELECT vec_id AS vid, CAST(unnest(embedding) AS DOUBLE) AS val, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings),
sup AS (SELECT l_suppkey AS src, l_partkey + (SELECT count(*) FROM supplier) AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)
"""


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = (PREFIX + sql) if not sql.lstrip().upper().startswith("WITH") else sql
        return fn

    return keep


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def long(x: DataFrame, *keys: str, vec: str = "h", digits: int = 6) -> DataFrame:
    keys = keys or ("vid",)
    return to_long(x, keys, vec).select(*keys, "dim", rounded("val", digits).alias("val"))


def features(s: SparkSession, d: str) -> DataFrame:
    return T.vertices(s, d).select("vid", "h")


# sources and preparation

query("edge_scan", "SELECT src, dst FROM e0")(lambda s, d: T.plain_graph(s, d).edges)
query("self_loops", "SELECT src, dst FROM e")(lambda s, d: T.graph(s, d).edges)
query("remove_self_loops", "SELECT src, dst FROM e0 WHERE src <> dst")(lambda s, d: T.plain_graph(s, d).without_self_loops().edges)
query("symmetrize_bag", "SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0")(lambda s, d: T.plain_graph(s, d).symmetrize().edges)
query("symmetrize_distinct", "SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0")(lambda s, d: T.plain_graph(s, d).symmetrize(True).edges)
query("dedup_edges", "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0)")(lambda s, d: T.plain_graph(s, d).symmetrize().dedup().edges)
query("transpose", "SELECT dst AS src, src AS dst FROM e0")(lambda s, d: T.plain_graph(s, d).transpose().edges)
query("mask_split", "SELECT mask, count(*) AS vertices FROM v GROUP BY mask")(lambda s, d: T.vertices(s, d).groupBy("mask").agg(F.count("*").alias("vertices")))
query("first_k_split", "SELECT vid, CASE WHEN vid < 100 THEN 'train' WHEN vid < 200 THEN 'val' WHEN vid < 300 THEN 'test' ELSE 'unknown' END AS part FROM v")(lambda s, d: T.split_by_rank(T.vertices(s, d)))
query("hash_split", "SELECT vid, CASE WHEN vid * 7919 % 1000003 % 100 < 60 THEN 0 WHEN vid * 7919 % 1000003 % 100 < 80 THEN 1 ELSE 2 END AS part FROM v")(
    lambda s, d: T.vertices(s, d).select("vid", F.when(F.col("vid") * 7919 % 1000003 % 100 < 60, 0).when(F.col("vid") * 7919 % 1000003 % 100 < 80, 1).otherwise(2).alias("part"))
)
query("label_counts", "SELECT label, count(*) AS vertices FROM v GROUP BY label")(lambda s, d: T.vertices(s, d).groupBy("label").agg(F.count("*").alias("vertices")))
query("train_removed_edges", "SELECT e.src, e.dst, a.mask <> 0 OR b.mask <> 0 AS removed FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst")(lambda s, d: T.removed_edges(T.graph(s, d), T.vertices(s, d)))
query("random_source", "SELECT vid, label, CAST(vid % 3 AS INTEGER) AS mask, dim, 1.0::DOUBLE AS val FROM (SELECT vid, (vid * 7919 + 7) % 1000003 % 10 AS label FROM v), (SELECT CAST(unnest(range(16)) AS INTEGER) AS dim)")(
    lambda s, d: T.random_source(s, T.vertices(s, d).count(), 16, 10).select("vid", "label", "mask", F.posexplode("h").alias("dim", "val"))
)
query(
    "standardize_train",
    ", st AS (SELECT dim, avg(val) AS mu, stddev_pop(val) AS sd FROM f WHERE vid % 3 = 0 GROUP BY dim) SELECT vid, dim, round((val - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS val FROM f JOIN st USING (dim)",
)(lambda s, d: long(T.standardize(T.vertices(s, d))))

# structure

query("out_degree", "SELECT vid, coalesce(c, 0) AS degree FROM v LEFT JOIN (SELECT src, count(*) AS c FROM et GROUP BY src) ON src = vid")(lambda s, d: T.plain_graph(s, d).degrees("src"))
query("in_degree", "SELECT vid, coalesce(c, 0) AS degree FROM v LEFT JOIN (SELECT dst, count(*) AS c FROM et GROUP BY dst) ON dst = vid")(lambda s, d: T.plain_graph(s, d).degrees("dst"))
query("degree_clamped", "SELECT vid, greatest(coalesce(c, 0), 1) AS degree FROM v LEFT JOIN (SELECT dst, count(*) AS c FROM et GROUP BY dst) ON dst = vid")(
    lambda s, d: T.plain_graph(s, d).degrees("dst").select("vid", F.greatest("degree", F.lit(1)).cast("long").alias("degree"))
)
query("norm_weight", "SELECT src, dst, round(w, 6) + 0.0 AS w FROM w")(lambda s, d: T.graph(s, d).norm_weights.select("src", "dst", rounded("w").alias("w")))
query("const_weight", "SELECT src, dst, 1.0::DOUBLE AS w FROM e")(lambda s, d: T.graph(s, d).weights(lambda a, b: F.lit(1.0)))
query("custom_weight", "SELECT src, dst, round((src % 7 + 1) / (dst % 5 + 1), 6) + 0.0 AS w FROM e")(
    lambda s, d: T.graph(s, d).weights(lambda a, b: (a % 7 + 1) / (b % 5 + 1)).select("src", "dst", rounded("w").alias("w"))
)
_OFFSETS = "SELECT vid, CAST(coalesce(sum(coalesce(c, 0)) OVER (ORDER BY vid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM v LEFT JOIN (SELECT {0}, count(*) AS c FROM et GROUP BY {0}) ON {0} = vid"
query("csc_offsets", _OFFSETS.format("dst"))(lambda s, d: T.plain_graph(s, d).offsets("dst"))
query("csr_offsets", _OFFSETS.format("src"))(lambda s, d: T.plain_graph(s, d).offsets("src"))
query("edge_ids", "SELECT src, dst, row_number() OVER (ORDER BY dst, src) - 1 AS eid FROM e")(lambda s, d: T.graph(s, d).edge_ids())
query("mirror_index", "SELECT src AS vid, row_number() OVER (ORDER BY src) - 1 AS slot FROM (SELECT DISTINCT src FROM et)")(lambda s, d: T.plain_graph(s, d).mirrors())
query("mirror_semijoin", "SELECT DISTINCT CAST(dst // 100 AS BIGINT) AS p, src AS vid FROM et")(lambda s, d: T.plain_graph(s, d).mirrored_at(lambda v: F.floor(v / 100)))
_OWN = lambda v: F.floor(v / 100)
_SLOTS = ", ms AS (SELECT p, vid, row_number() OVER (PARTITION BY p ORDER BY vid) - 1 AS slot FROM (SELECT DISTINCT CAST(dst // 100 AS BIGINT) AS p, src AS vid FROM et)) "
_OFFS = _SLOTS + ", mo AS (SELECT ms.p, slot, vid, CAST(coalesce(sum(degree) OVER (PARTITION BY ms.p ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, degree FROM ms JOIN (SELECT CAST(dst // 100 AS BIGINT) AS p, src, count(*) AS degree FROM et GROUP BY 1, 2) d ON d.p = ms.p AND d.src = vid) "
query("mirror_slots", _SLOTS + "SELECT p, vid, slot FROM ms")(lambda s, d: T.plain_graph(s, d).mirror_slots(_OWN))
query("slot_offsets", _OFFS + "SELECT p, slot, vid, start, degree FROM mo")(lambda s, d: T.plain_graph(s, d).slot_offsets(_OWN))
query("slot_edges", _OFFS + "SELECT mo.p, slot, start + row_number() OVER (PARTITION BY mo.p, mo.vid ORDER BY dst) - 1 AS place, dst FROM et JOIN mo ON mo.p = CAST(dst // 100 AS BIGINT) AND mo.vid = src")(lambda s, d: T.plain_graph(s, d).slot_edges(_OWN))
query("message_lists", _SLOTS + "SELECT CAST(vid // 100 AS BIGINT) AS owner, p AS needer, row_number() OVER (PARTITION BY CAST(vid // 100 AS BIGINT), p ORDER BY vid) - 1 AS place, vid, slot FROM ms")(lambda s, d: T.plain_graph(s, d).message_lists(_OWN))
query("chunk_edge_counts", "SELECT CAST(src // 100 AS BIGINT) AS psrc, CAST(dst // 100 AS BIGINT) AS pdst, count(*) AS edges FROM e GROUP BY ALL")(lambda s, d: T.graph(s, d).chunks(lambda v: F.floor(v / 100)))
query("owner_lookup", "SELECT vid, CASE WHEN vid >= 300 THEN 3 WHEN vid >= 200 THEN 2 WHEN vid >= 64 THEN 1 ELSE 0 END AS part FROM v")(lambda s, d: T.vertices(s, d).select("vid", owner_of([0, 64, 200, 300, 1 << 40])(F.col("vid")).alias("part")))
query(
    "degree_histogram",
    ", d AS (SELECT vid, coalesce(c, 0) AS c FROM v LEFT JOIN (SELECT src, count(*) AS c FROM et GROUP BY src) ON src = vid), b AS (SELECT CASE WHEN c = 0 THEN -1 ELSE CAST(floor(log2(c)) AS INTEGER) END AS bucket, count(*) AS vertices FROM d GROUP BY 1) SELECT bucket, vertices, round(vertices * 100.0 / sum(vertices) OVER (), 6) + 0.0 AS share FROM b",
)(lambda s, d: T.plain_graph(s, d).degree_histogram().withColumn("share", rounded("share")))
query("max_avg_degree", ", d AS (SELECT vid, coalesce(c, 0) AS c FROM v LEFT JOIN (SELECT dst, count(*) AS c FROM et GROUP BY dst) ON dst = vid) SELECT max(c) AS max_degree, CAST(floor(sum(c) / count(*)) AS BIGINT) AS mean_degree FROM d")(
    lambda s, d: T.plain_graph(s, d).degree_summary("dst").select("max_degree", "mean_degree")
)
query("max_degree_vertex", ", d AS (SELECT vid, coalesce(c, 0) AS c FROM v LEFT JOIN (SELECT dst, count(*) AS c FROM et GROUP BY dst) ON dst = vid) SELECT vid, c AS degree FROM d ORDER BY c DESC, vid LIMIT 1")(
    lambda s, d: T.plain_graph(s, d).degree_summary("dst").select("vid", F.col("max_degree").alias("degree"))
)
query("active_filter", "SELECT src, dst FROM e WHERE src % 4 <> 1 AND dst % 4 <> 1")(lambda s, d: T.graph(s, d).active(F.col("vid") % 4 != 1).edges)
query("vertex_map_reduce", "SELECT round(sum(val * val), 6) + 0.0 AS total FROM f WHERE vid % 4 <> 1")(
    lambda s, d: M.map_reduce(features(s, d), F.col("vid") % 4 != 1, F.aggregate("h", F.lit(0.0), lambda a, v: a + v * v)).select(rounded("total").alias("total"))
)
query("hash_partition", "SELECT vid * 7919 % 1000003 % 8 AS part, count(*) AS vertices FROM v GROUP BY 1")(lambda s, d: T.vertices(s, d).groupBy((F.col("vid") * 7919 % 1000003 % 8).alias("part")).agg(F.count("*").alias("vertices")))

# scatters


def _m(x: DataFrame) -> DataFrame:
    return long(x, "src", "dst", vec="m")


def _rounded(s: SparkSession, d: str) -> DataFrame:
    """Features as long() rounds them: what only copies them is rounded once a vertex, not once an edge."""
    return features(s, d).select("vid", F.transform("h", lambda v: F.round(v, 6) + F.lit(0.0)).alias("h"))


def _copied(x: DataFrame) -> DataFrame:
    return to_long(x, ("src", "dst"), "m")


query("scatter_src", f"SELECT src, dst, dim, round(val, 6) + 0.0 AS val FROM e JOIN f ON f.vid = src")(lambda s, d: _copied(M.Scatter(T.graph(s, d), W64).forward(_rounded(s, d))))
query("scatter_dst", f"SELECT src, dst, dim, round(val, 6) + 0.0 AS val FROM e JOIN f ON f.vid = dst")(lambda s, d: _copied(M.Scatter(T.graph(s, d), W64, "dst").forward(_rounded(s, d))))
query("scatter_src_dst", f"SELECT src, dst, dim, round(val, 6) + 0.0 AS val FROM e JOIN f ON f.vid = src UNION ALL SELECT src, dst, CAST(dim + 64 AS INTEGER), round(val, 6) + 0.0 FROM e JOIN f ON f.vid = dst")(
    lambda s, d: _copied(M.Scatter(T.graph(s, d), W64, "both").forward(_rounded(s, d)))
)

#: An edge gradient that SQL and Spark can both write down: element i of edge (src, dst).
_G = "(src * 3 + dst * 5 + dim * 7) % 11 - 5"


def _edge_numbers(width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: ((F.col("src") * 3 + F.col("dst") * 5 + i * 7) % 11 - 5).cast("double"))


def _edge_gradient(g: Graph, width: int) -> DataFrame:
    return g.edges.select("src", "dst", _edge_numbers(width).alias("m"))


def _fill(inner: str, width: int) -> str:
    return f"SELECT v.vid, dim, round(coalesce(s.val, 0), 6) + 0.0 AS val FROM v CROSS JOIN (SELECT CAST(unnest(range({width})) AS INTEGER) AS dim) k LEFT JOIN ({inner}) s USING (vid, dim)"


_DIMS = "(SELECT CAST(unnest(range({0})) AS INTEGER) AS dim)"
for _end in ("src", "dst"):
    query(f"scatter_{_end}_bwd", _fill(f"SELECT {_end} AS vid, dim, sum({_G}) AS val FROM et, {_DIMS.format(64)} GROUP BY 1, 2", W64))(
        lambda s, d, end=_end: long(M.Scatter(T.plain_graph(s, d), W64, end).backward(_edge_gradient(T.plain_graph(s, d), W64)))
    )
query(
    "scatter_src_dst_bwd",
    _fill(f"SELECT vid, dim, sum(val) AS val FROM (SELECT src AS vid, dim, {_G} AS val FROM et, {_DIMS.format(64)} UNION ALL SELECT dst, dim, (src * 3 + dst * 5 + (dim + 64) * 7) % 11 - 5 FROM et, {_DIMS.format(64)}) GROUP BY 1, 2", W64),
)(lambda s, d: long(M.Scatter(T.plain_graph(s, d), W64, "both").backward(_edge_gradient(T.plain_graph(s, d), 2 * W64))))
query("dep_neighbor", f"SELECT vid, dim, round(val, 6) + 0.0 AS val FROM f WHERE vid IN (SELECT src FROM et)")(lambda s, d: long(M.dependencies(T.plain_graph(s, d), features(s, d))))
query("dep_neighbor_bwd", _fill(f"SELECT src AS vid, dim, sum({_G}) AS val FROM et, {_DIMS.format(64)} GROUP BY 1, 2", W64))(lambda s, d: long(M.Scatter(T.plain_graph(s, d), W64).backward(_edge_gradient(T.plain_graph(s, d), W64))))
_IDS = "(SELECT vid AS pos, (vid * 37 + 11) % (SELECT n FROM n) AS vid FROM v)"


def _ids(s, d):
    v = T.vertices(s, d).select("vid")
    return v.select(F.col("vid").alias("pos"), ((F.col("vid") * 37 + 11) % v.count()).alias("vid"))


query("feature_gather", f"SELECT pos, dim, round(val, 6) + 0.0 AS val FROM {_IDS} i JOIN f ON f.vid = i.vid")(lambda s, d: long(M.by_position(_ids(s, d), features(s, d)), "pos"))
query("label_gather", f"SELECT pos, label FROM {_IDS} i JOIN v ON v.vid = i.vid")(lambda s, d: M.by_position(_ids(s, d), T.vertices(s, d)).select("pos", "label"))
query("slice_concat", "SELECT vid, CAST(dim - 32 AS INTEGER) AS dim, round(val, 6) + 0.0 AS val FROM f WHERE dim >= 32 UNION ALL SELECT vid, CAST(dim + 32 AS INTEGER), round(val, 6) + 0.0 FROM f WHERE dim < 32")(
    lambda s, d: long(features(s, d).select("vid", F.concat(F.slice("h", 33, 32), F.slice("h", 1, 32)).alias("h")))
)

# gathers, over the graph without loops

query("agg_sum", _fill(f"SELECT dst AS vid, dim, sum(val) AS val FROM et JOIN f ON f.vid = src GROUP BY 1, 2", W64))(
    lambda s, d: long(M.GatherSum(g := T.plain_graph(s, d), W64).forward(M.Scatter(g, W64).forward(features(s, d))))
)
query("agg_sum_bwd", f"SELECT src, dst, dim, round(val, 6) + 0.0 AS val FROM et JOIN f ON f.vid = dst")(lambda s, d: _copied(M.GatherSum(T.plain_graph(s, d), W64).backward(_rounded(s, d))))
for _k, _zero in (("min", "least"), ("max", "greatest")):
    query(f"agg_{_k}", _fill(f"SELECT dst AS vid, dim, {_k}(val) AS val FROM et JOIN f ON f.vid = src GROUP BY 1, 2", W64))(
        lambda s, d, k=_k: long(M.GatherExtreme(g := T.plain_graph(s, d), W64, k).forward(M.Scatter(g, W64).forward(features(s, d))))
    )
    query(f"agg_{_k}_compat", _fill(f"SELECT dst AS vid, dim, {_zero}({_k}(val), 0) AS val FROM et JOIN f ON f.vid = src GROUP BY 1, 2", W64))(
        lambda s, d, k=_k: long(M.GatherExtreme(g := T.plain_graph(s, d), W64, k, True).forward(M.Scatter(g, W64).forward(features(s, d))))
    )
    query(f"agg_arg{_k}", f"SELECT dst, dim, src AS \"from\" FROM (SELECT dst, dim, src, row_number() OVER (PARTITION BY dst, dim ORDER BY val {'ASC' if _k == 'min' else 'DESC'}, src) AS r FROM et JOIN f ON f.vid = src) WHERE r = 1")(
        lambda s, d, k=_k: to_long(M.GatherExtreme(g := T.plain_graph(s, d), W64, k).sources(M.Scatter(g, W64).forward(features(s, d))), "dst", "from").withColumnRenamed("val", "from")
    )
    query(
        f"agg_{_k}_bwd",
        f", a AS (SELECT dst, dim, src, row_number() OVER (PARTITION BY dst, dim ORDER BY val {'ASC' if _k == 'min' else 'DESC'}, src) AS r FROM et JOIN f ON f.vid = src) SELECT a.src, a.dst, a.dim, CASE WHEN r = 1 THEN round(val, 6) + 0.0 ELSE 0.0 END AS val FROM a JOIN f ON f.vid = a.dst AND f.dim = a.dim",
    )(lambda s, d, k=_k: _m(M.GatherExtreme(g := T.plain_graph(s, d), W64, k).backward(M.Scatter(g, W64).forward(features(s, d)), features(s, d))))
query("agg_unweighted", _fill("SELECT dst AS vid, dim, sum(val) AS val FROM et JOIN f ON f.vid = src GROUP BY 1, 2", W64))(lambda s, d: long(M.Aggregate(T.plain_graph(s, d), W64).forward(features(s, d))))
query("norm_agg", "SELECT dst AS vid, dim, round(sum(w * val), 6) + 0.0 AS val FROM w JOIN f ON f.vid = src GROUP BY 1, 2")(lambda s, d: long(M.norm_aggregate(T.graph(s, d), W64).forward(features(s, d))))
query("norm_agg_bwd", "SELECT src AS vid, dim, round(sum(w * val), 6) + 0.0 AS val FROM w JOIN f ON f.vid = dst GROUP BY 1, 2")(lambda s, d: long(M.norm_aggregate(T.graph(s, d), W64).backward(features(s, d))))

# all vertices of orders lead to vertex 0, and it leads to all customers: two hubs
_STAR = ", st AS (SELECT DISTINCT o_orderkey % n AS src, CAST(0 AS BIGINT) AS dst FROM orders, n UNION SELECT CAST(0 AS BIGINT), o_custkey % n FROM orders, n UNION SELECT vid, vid FROM v), so AS (SELECT src, count(*) AS o FROM st GROUP BY 1), si AS (SELECT dst, count(*) AS i FROM st GROUP BY 1), sw AS (SELECT st.src, st.dst, 1 / (sqrt(o) * sqrt(i)) AS w FROM st JOIN so ON so.src = st.src JOIN si ON si.dst = st.dst) "
query("balanced_norm_agg", "SELECT dst AS vid, dim, round(sum(w * val), 6) + 0.0 AS val FROM w JOIN f ON f.vid = src GROUP BY 1, 2")(lambda s, d: long(_balanced(T.graph(s, d)).forward(features(s, d))))
query("star_norm_agg", _STAR + "SELECT dst AS vid, dim, round(sum(w * val), 6) + 0.0 AS val FROM sw JOIN f ON f.vid = src GROUP BY 1, 2")(lambda s, d: long(_balanced(T.star(s, d)).forward(features(s, d))))
query("star_norm_agg_bwd", _STAR + "SELECT src AS vid, dim, round(sum(w * val), 6) + 0.0 AS val FROM sw JOIN f ON f.vid = dst GROUP BY 1, 2")(lambda s, d: long(_balanced(T.star(s, d)).backward(features(s, d))))


def _balanced(g: Graph) -> M.BalancedAggregate:
    return M.BalancedAggregate(g, W64, g.norm_weights)


#: A signed weight of every edge, standing for one that is learned.
_A = "((src * 13 + dst * 17) % 23 - 11) / 7.0"


def _learned(g: Graph) -> M.Aggregate:
    return M.Aggregate(g, W64, g.weights(lambda a, b: ((a * 13 + b * 17) % 23 - 11) / 7.0))


query("weighted_agg", f"SELECT dst AS vid, dim, round(sum({_A} * val), 6) + 0.0 AS val FROM e JOIN f ON f.vid = src GROUP BY 1, 2")(lambda s, d: long(_learned(T.graph(s, d)).forward(features(s, d))))
query("weighted_agg_bwd_x", f"SELECT src AS vid, dim, round(sum({_A} * val), 6) + 0.0 AS val FROM e JOIN f ON f.vid = dst GROUP BY 1, 2")(lambda s, d: long(_learned(T.graph(s, d)).backward(features(s, d))))
query("weighted_agg_bwd_w", "SELECT src, dst, round(sum(a.val * b.val), 6) + 0.0 AS w FROM e JOIN f a ON a.vid = src JOIN f b ON b.vid = dst AND b.dim = a.dim GROUP BY 1, 2")(
    lambda s, d: _learned(T.graph(s, d)).backward_weights(features(s, d), features(s, d)).select("src", "dst", rounded("w").alias("w"))
)
query("supply_weighted_agg", "SELECT dst AS vid, round(sum(w * (src % 10)), 6) + 0.0 AS val FROM sup GROUP BY dst")(
    lambda s, d: T.supply(s, d).groupBy(F.col("dst").alias("vid")).agg(rounded(F.sum(F.col("w") * (F.col("src") % 10))).alias("val"))
)
query("partial_sums", "SELECT dim, round(sum(val), 6) + 0.0 AS val FROM f GROUP BY dim")(lambda s, d: fold_vectors(features(s, d), None, W64, F.sum, "h").select(F.posexplode("h").alias("dim", "v")).select("dim", rounded("v").alias("val")))

# softmax over the in-edges of a vertex

_SM = ", fs AS (SELECT vid, sum(val) AS s FROM f GROUP BY vid), sc AS (SELECT src, dst, s FROM e JOIN fs ON fs.vid = src), ex AS (SELECT src, dst, exp(s - max(s) OVER (PARTITION BY dst)) AS x FROM sc), sm AS (SELECT src, dst, x / sum(x) OVER (PARTITION BY dst) AS a FROM ex) "


def _scores(s, d):
    total = features(s, d).select("vid", F.array(F.aggregate("h", F.lit(0.0), lambda a, v: a + v)).alias("h"))
    return M.Scatter(T.graph(s, d), 1).forward(total).select("src", "dst", F.col("m")[0].alias("s"))


query("edge_softmax", _SM + "SELECT src, dst, round(a, 6) + 0.0 AS a FROM sm")(lambda s, d: M.EdgeSoftmax().forward(_scores(s, d)).select("src", "dst", rounded("a").alias("a")))
query("edge_softmax_bwd", _SM + ", g AS (SELECT src, dst, a, (src * 3 + dst * 5) % 11 - 5 AS g FROM sm) SELECT src, dst, round(a * (g - sum(a * g) OVER (PARTITION BY dst)), 6) + 0.0 AS s FROM g")(
    lambda s, d: M.EdgeSoftmax().backward(M.EdgeSoftmax().forward(_scores(s, d)).withColumn("g", (F.col("src") * 3 + F.col("dst") * 5) % 11 - 5)).select("src", "dst", rounded("s").alias("s"))
)

_SM8 = ", sc AS (SELECT src, dst, dim, val AS s FROM e JOIN f ON f.vid = src WHERE dim < 8), ex AS (SELECT src, dst, dim, exp(s - max(s) OVER (PARTITION BY dst, dim)) AS x FROM sc), sm AS (SELECT src, dst, dim, x / sum(x) OVER (PARTITION BY dst, dim) AS a FROM ex) "


def _columns(s, d):
    """Eight scores of each edge."""
    return M.Scatter(T.graph(s, d), 8).forward(features(s, d).withColumn("h", F.slice("h", 1, 8))).withColumnRenamed("m", "s")


query("edge_softmax_columns", _SM8 + "SELECT src, dst, dim, round(a, 6) + 0.0 AS val FROM sm")(lambda s, d: long(M.EdgeSoftmax(8).forward(_columns(s, d)), "src", "dst", vec="a"))
query("edge_softmax_columns_bwd", _SM8 + f", g AS (SELECT src, dst, dim, a, {_G} AS g FROM sm) SELECT src, dst, dim, round(a * (g - sum(a * g) OVER (PARTITION BY dst, dim)), 6) + 0.0 AS val FROM g")(
    lambda s, d: long(M.EdgeSoftmax(8).backward(M.EdgeSoftmax(8).forward(_columns(s, d)).withColumn("g", _edge_numbers(8))), "src", "dst", vec="s")
)

# dense layers

_WT = "(SELECT i, j, sqrt(6.0 / ({0} + {1})) * sin(0.37 * i + 0.11 * j + 0.5 * {2}) AS w FROM (SELECT CAST(unnest(range({0})) AS INTEGER) AS i), (SELECT CAST(unnest(range({1})) AS INTEGER) AS j))"


def _wt(a: int, b: int, k: int = 0) -> str:
    return _WT.format(a, b, k)


_LOGITS = f", lg AS (SELECT vid, j AS dim, sum(val * w) AS val FROM f JOIN {_wt(64, 10)} k ON k.i = f.dim GROUP BY 1, 2), lp AS (SELECT vid, dim, val - max(val) OVER (PARTITION BY vid) AS z FROM lg), ls AS (SELECT vid, dim, z - ln(sum(exp(z)) OVER (PARTITION BY vid)) AS val FROM lp) "


def _logits(s, d):
    return nn.linear(T.vertices(s, d), nn.fixed_weight(64, 10))


query("linear", f"SELECT vid, j AS dim, round(sum(val * w), 6) + 0.0 AS val FROM f JOIN {_wt(64, 32)} k ON k.i = f.dim GROUP BY 1, 2")(lambda s, d: long(nn.linear(features(s, d), nn.fixed_weight(64, 32))))
query("relu", "SELECT vid, dim, round(greatest(val, 0), 6) + 0.0 AS val FROM f")(lambda s, d: long(features(s, d).select("vid", nn.relu(F.col("h")).alias("h"))))
query("leaky_relu", "SELECT vid, dim, round(CASE WHEN val > 0 THEN val ELSE 0.2 * val END, 6) + 0.0 AS val FROM f")(lambda s, d: long(features(s, d).select("vid", F.transform("h", lambda v: nn.leaky(v)).alias("h"))))
query("sigmoid", "SELECT vid, dim, round(1 / (1 + exp(-val)), 6) + 0.0 AS val FROM f")(lambda s, d: long(features(s, d).select("vid", F.transform("h", lambda v: 1 / (1 + F.exp(-v))).alias("h"))))
query("log_softmax", _LOGITS + "SELECT vid, dim, round(val, 6) + 0.0 AS val FROM ls")(lambda s, d: long(_logits(s, d).select("vid", nn.log_softmax(F.col("h")).alias("h"))))
query("nll_loss", _LOGITS + "SELECT round(avg(-val), 6) + 0.0 AS loss FROM ls JOIN v ON v.vid = ls.vid AND v.label = ls.dim WHERE mask = 0")(
    lambda s, d: nn.nll(_logits(s, d).filter("mask = 0").withColumn("h", nn.log_softmax(F.col("h")))).select(rounded("loss").alias("loss"))
)
query("accuracy", _LOGITS + ", am AS (SELECT vid, dim FROM (SELECT vid, dim, row_number() OVER (PARTITION BY vid ORDER BY val DESC, dim) AS r FROM lg) WHERE r = 1) SELECT mask, count(*) AS n, CAST(sum(CASE WHEN dim = label THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(CASE WHEN dim = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM am JOIN v USING (vid) GROUP BY mask")(
    lambda s, d: nn.accuracy(_logits(s, d)).withColumn("accuracy", rounded("accuracy"))
)
query("batch_norm", ", st AS (SELECT dim, avg(val) AS mu, var_pop(val) AS va FROM f GROUP BY dim) SELECT vid, dim, round((val - mu) / sqrt(va + 1e-5), 6) + 0.0 AS val FROM f JOIN st USING (dim)")(lambda s, d: long(nn.batch_norm(features(s, d), W64)))
query("dropout_hash", "SELECT vid, dim, round(CASE WHEN (vid * 7919 + dim * 104729 + 112) % 1000003 >= 500001.5 THEN val / 0.5 ELSE 0 END, 6) + 0.0 AS val FROM f")(
    lambda s, d: long(features(s, d).select("vid", nn.dropout(F.col("h"), F.col("vid"), 0.5, seed=3, epoch=1, layer=2).alias("h")))
)
query("row_sum", "SELECT src, dst, round(sum(val), 6) + 0.0 AS val FROM e JOIN f ON f.vid = src GROUP BY 1, 2")(
    lambda s, d: M.Scatter(T.graph(s, d), W64).forward(features(s, d)).select("src", "dst", rounded(F.aggregate("m", F.lit(0.0), lambda a, v: a + v)).alias("val"))
)
query("add_scale", "SELECT vid, dim, round(val + 0.5 * val, 6) + 0.0 AS val FROM f")(lambda s, d: long(features(s, d).select("vid", F.zip_with("h", scale(F.col("h"), F.lit(0.5)), lambda a, b: a + b).alias("h"))))


#: Steps of an optimiser that starts with the fixed weight and follows the loss of a linear classifier over the vertices of mask 0.
STEPS = 2


def _steps(s: SparkSession, d: str, optimiser) -> DataFrame:
    v, model = T.vertices(s, d), Chain(Linear(nn.fixed_weight(64, 10)), LogSoftmax())
    x, truth = v.select("vid", "h"), v.select("vid", "label", "mask")
    n = truth.filter("mask = 0").count()
    for _ in range(STEPS):
        training.step(model, optimiser, model.forward(x), truth, n)
    w = model.learned()[0].weights["w"]
    rows = [(i, j, float(w[i, j])) for i in range(64) for j in range(10)]
    return s.createDataFrame(rows, "i int, j int, w double").select("i", "j", rounded("w", 5).alias("w"))


def _steps_sql(move) -> str:
    """Chained steps: gradients g of the loss at the weights w, with moments m and v, and move(t) as (m, v, w) of step t."""
    out = f", w0 AS (SELECT i, j, w, 0.0 AS m, 0.0 AS v FROM {_wt(64, 10)} k), tr AS (SELECT f.vid, dim, val, label FROM f JOIN v ON v.vid = f.vid WHERE mask = 0), tn AS (SELECT count(DISTINCT vid) AS c FROM tr)"
    for t in range(STEPS):
        m, v, w = move(t)
        out += (
            f", a{t} AS (SELECT vid, label, j, sum(val * w) AS z FROM tr JOIN w{t} ON i = dim GROUP BY 1, 2, 3), b{t} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vid)) AS x FROM a{t})"
            f", c{t} AS (SELECT vid, j, (x / sum(x) OVER (PARTITION BY vid) - CASE WHEN j = label THEN 1 ELSE 0 END) / (SELECT c FROM tn) AS d FROM b{t})"
            f", g{t} AS (SELECT w{t}.i, w{t}.j, w, m, v, g AS p, g + 1e-4 * w AS g FROM w{t} JOIN (SELECT dim AS i, j, sum(val * d) AS g FROM tr JOIN c{t} USING (vid) GROUP BY 1, 2) q ON q.i = w{t}.i AND q.j = w{t}.j)"
            f", h{t} AS (SELECT i, j, w, p, {m} AS m, {v} AS v FROM g{t}), w{t + 1} AS (SELECT i, j, {w} AS w, m, v FROM h{t})"
        )
    return out + f" SELECT i, j, round(w, 5) + 0.0 AS w FROM w{STEPS}"


def _adam(t: int) -> tuple[str, str, str]:
    return "0.9 * m + 0.1 * g", "0.999 * v + 0.001 * g * g", f"w - 0.01 * (m / (1 - power(0.9, {t + 1}))) / (sqrt(v / (1 - power(0.999, {t + 1}))) + 1e-9)"


def _adam_compat(t: int) -> tuple[str, str, str]:
    a, b = f"power(0.9, {t + 1})", f"power(0.999, {t + 1})"
    rate = f"0.01 * sqrt(1 - power(0.999, {t})) / (1 - power(0.9, {t}))" if t else "0.01"
    return f"{a} * m + (1 - {a}) * g", f"{b} * v + (1 - {b}) * g * g", f"w - {rate} * m / (sqrt(v) + 1e-9)"


query("adam_step", _steps_sql(_adam))(lambda s, d: _steps(s, d, Adam()))
query("adam_step_compat", _steps_sql(_adam_compat))(lambda s, d: _steps(s, d, Adam(compat=True)))
query("sgd_step", _steps_sql(lambda t: ("m", "v", "(w - 0.01 * p) * (1 - 1e-4)")))(lambda s, d: _steps(s, d, SGD()))

# sampling

_H = "(src * 7919 + dst * 104729 + {0}) % 1000003"
_DRAW = "SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY " + _H.format(0) + ", src) AS r FROM e) WHERE r <= 5"
_HOPS = (
    ", sb AS (SELECT CAST((row_number() OVER (ORDER BY vid) - 1) // 64 AS BIGINT) AS batch_id, vid FROM v WHERE mask = 0), h0 AS (SELECT batch_id, dst, src FROM (SELECT batch_id, dst, src, row_number() OVER (PARTITION BY batch_id, dst ORDER BY "
    + _H.format(0)
    + ", src) AS r FROM e JOIN sb ON sb.vid = e.dst) WHERE r <= 5), f1 AS (SELECT DISTINCT batch_id, src AS vid FROM h0), h1 AS (SELECT batch_id, dst, src FROM (SELECT batch_id, dst, src, row_number() OVER (PARTITION BY batch_id, dst ORDER BY "
    + _H.format(1)
    + ", src) AS r FROM e JOIN f1 ON f1.vid = e.dst) WHERE r <= 10), hops AS (SELECT batch_id, 0 AS hop, dst, src FROM h0 UNION ALL SELECT batch_id, 1, dst, src FROM h1) "
)


def _batches(s, d):
    return sampling.seed_batches(T.vertices(s, d).filter("mask = 0"), 64)


def _hops(s, d):
    return sampling.expand(T.graph(s, d).edges, _batches(s, d), [5, 10])


query("fanout_sample", _DRAW)(lambda s, d: sampling.sample_neighbours(T.graph(s, d).edges, 5))
query("seed_batches", "SELECT CAST((row_number() OVER (ORDER BY vid) - 1) // 64 AS BIGINT) AS batch_id, vid FROM v WHERE mask = 0")(_batches)
query("two_hop_sample", _HOPS + "SELECT batch_id, hop, dst, src FROM hops")(_hops)
query("relabel", _HOPS + "SELECT batch_id, src AS vid, row_number() OVER (PARTITION BY batch_id ORDER BY p) - 1 AS local FROM (SELECT batch_id, src, min(dst * 1000000 + src) AS p FROM h0 GROUP BY 1, 2)")(
    lambda s, d: sampling.relabel(_hops(s, d).filter("hop = 0").withColumn("pos", F.col("dst") * 1000000 + F.col("src")), "pos", "src", ("batch_id",))
)
query("minibatch_agg", _HOPS + f"SELECT h.batch_id, h.dst AS vid, dim, round(sum(w.w * val), 6) + 0.0 AS val FROM h0 h JOIN w ON w.src = h.src AND w.dst = h.dst JOIN f ON f.vid = h.src GROUP BY 1, 2, 3")(
    lambda s, d: _block_sum(s, d, lambda op, x: op.forward(x), "src", "dst")
)
query("minibatch_agg_bwd", _HOPS + "SELECT h.batch_id, h.src AS vid, dim, round(sum(w.w * val), 6) + 0.0 AS val FROM h0 h JOIN w ON w.src = h.src AND w.dst = h.dst JOIN f ON f.vid = h.dst GROUP BY 1, 2, 3")(
    lambda s, d: _block_sum(s, d, lambda op, g: op.backward(g), "dst", "src")
)
_LOCAL = (
    ", sb AS (SELECT CAST((row_number() OVER (ORDER BY vid) - 1) // 64 AS BIGINT) AS batch_id, vid FROM v WHERE mask = 0), sl AS (SELECT batch_id, vid, row_number() OVER (PARTITION BY batch_id ORDER BY vid) - 1 AS local FROM sb)"
    + "".join(
        f", d{i} AS (SELECT * FROM (SELECT batch_id, e.dst, e.src, local AS dst_local, row_number() OVER (PARTITION BY batch_id, e.dst ORDER BY {_H.format(i)}, e.src) AS r FROM e JOIN {front} ON vid = e.dst) WHERE r <= {fanout}),"
        f" n{i} AS (SELECT batch_id, src AS vid, row_number() OVER (PARTITION BY batch_id ORDER BY min(dst_local * {fanout} + r)) - 1 AS local FROM d{i} GROUP BY 1, 2),"
        f" b{i} AS (SELECT d{i}.batch_id, {i} AS hop, dst, src, dst_local, local AS src_local FROM d{i} JOIN n{i} ON n{i}.batch_id = d{i}.batch_id AND n{i}.vid = d{i}.src)"
        for i, front, fanout in ((0, "sl", 5), (1, "n0", 10))
    )
    + " "
)
query("sampled_blocks", _LOCAL + "SELECT b.batch_id, hop, b.dst, b.src, dst_local, src_local, round(w, 6) + 0.0 AS w FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1) b JOIN w ON w.src = b.src AND w.dst = b.dst")(
    lambda s, d: _blocks(s, d).withColumn("w", rounded("w"))
)
# one pass over all batches with fixed weights: layer 0 walks hop 1, layer 1 hop 0, and the gradients walk back
_SAMPLED = (
    _HOPS
    + f", p0 AS (SELECT i, j, w AS p FROM {_wt(64, 16)} k), p1 AS (SELECT i, j, w AS p FROM {_wt(16, 10, 1)} k)"
    + ", y1 AS (SELECT batch_id, h.dst AS vid, dim, sum(w.w * val) AS val FROM h1 h JOIN w ON w.src = h.src AND w.dst = h.dst JOIN f ON f.vid = h.src GROUP BY 1, 2, 3)"
    + ", z1 AS (SELECT batch_id, vid, j AS dim, sum(val * p) AS val FROM y1 JOIN p0 ON i = dim GROUP BY 1, 2, 3)"
    + ", y0 AS (SELECT h.batch_id, h.dst AS vid, dim, sum(w.w * greatest(val, 0)) AS val FROM h0 h JOIN w ON w.src = h.src AND w.dst = h.dst JOIN z1 ON z1.batch_id = h.batch_id AND z1.vid = h.src GROUP BY 1, 2, 3)"
    + ", z0 AS (SELECT batch_id, vid, j AS dim, sum(val * p) AS val FROM y0 JOIN p1 ON i = dim GROUP BY 1, 2, 3)"
    + ", t0 AS (SELECT batch_id, vid, dim, val - max(val) OVER (PARTITION BY batch_id, vid) AS val FROM z0)"
    + ", o0 AS (SELECT batch_id, vid, dim, val - ln(sum(exp(val)) OVER (PARTITION BY batch_id, vid)) AS val FROM t0) "
)
query("minibatch_logits", _SAMPLED + "SELECT batch_id, vid, dim, round(val, 4) + 0.0 AS val FROM o0")(lambda s, d: long(sampled.outputs(_packed(s, d), _fixed()), "batch_id", "vid", digits=4))
query(
    "minibatch_gradients",
    _SAMPLED
    + ", bn AS (SELECT batch_id, count(*) AS n FROM sb GROUP BY 1), g0 AS (SELECT o0.batch_id, o0.vid, dim, (exp(val) - CASE WHEN dim = label THEN 1 ELSE 0 END) / bn.n AS g FROM o0 JOIN bn USING (batch_id) JOIN v USING (vid))"
    + ", q1 AS (SELECT y0.batch_id, 1 AS layer, y0.dim AS i, g0.dim AS j, sum(val * g) AS val FROM y0 JOIN g0 ON g0.batch_id = y0.batch_id AND g0.vid = y0.vid GROUP BY ALL)"
    + ", gy AS (SELECT batch_id, vid, i AS dim, sum(g * p) AS g FROM g0 JOIN p1 ON j = dim GROUP BY 1, 2, 3)"
    + ", gz AS (SELECT h.batch_id, h.src AS vid, dim, sum(w.w * g) AS g FROM h0 h JOIN w ON w.src = h.src AND w.dst = h.dst JOIN gy ON gy.batch_id = h.batch_id AND gy.vid = h.dst GROUP BY 1, 2, 3)"
    + ", gr AS (SELECT gz.batch_id, gz.vid, gz.dim, CASE WHEN val > 0 THEN g ELSE 0 END AS g FROM gz JOIN z1 ON z1.batch_id = gz.batch_id AND z1.vid = gz.vid AND z1.dim = gz.dim)"
    + ", q0 AS (SELECT y1.batch_id, 0 AS layer, y1.dim AS i, gr.dim AS j, sum(val * g) AS val FROM y1 JOIN gr ON gr.batch_id = y1.batch_id AND gr.vid = y1.vid GROUP BY ALL)"
    + " SELECT batch_id, layer, i, j, round(val, 5) + 0.0 AS val FROM (SELECT * FROM q0 UNION ALL SELECT * FROM q1)",
)(lambda s, d: _sampled_gradients(s, d))


def _blocks(s, d):
    return sample_blocks(T.graph(s, d), _batches(s, d), [5, 10])


def _block_sum(s, d, use, given: str, to: str) -> DataFrame:
    """An aggregation over hop 0 of all batches with features given at one side; local ids are turned to vertices again."""
    blocks, batches = _blocks(s, d), _batches(s, d)
    names = {"src": sources_of(blocks, 0), "dst": numbered_seeds(batches)}
    x = names[given].join(features(s, d), "vid").select("batch_id", "local", "h")
    return long(use(BlockAggregate(blocks, batches, 0, W64), x).join(names[to], ["batch_id", "local"]), "batch_id", "vid")


def _fixed() -> list[np.ndarray]:
    return [nn.fixed_weight(64, 16), nn.fixed_weight(16, 10, 1)]


def _packed(s, d):
    return sampled.pack(_blocks(s, d), _batches(s, d), features(s, d), T.vertices(s, d), 2)


def _sampled_gradients(s, d) -> DataFrame:
    at = F.posexplode("grads").alias("k", "val")
    cut = 64 * 16
    g = sampled.batch_gradients(_packed(s, d), _fixed()).select("batch_id", at).select("batch_id", (F.col("k") >= cut).cast("int").alias("layer"), (F.col("k") % cut).alias("k"), "val")
    cols = F.when(F.col("layer") == 0, 16).otherwise(10)
    return g.select("batch_id", "layer", F.floor(F.col("k") / cols).cast("int").alias("i"), (F.col("k") % cols).cast("int").alias("j"), rounded("val", 5).alias("val"))


# models, forward with fixed weights


def _agg(x: str) -> str:
    return f"(SELECT dst AS vid, dim, sum(w * val) AS val FROM w JOIN {x} x ON x.vid = src GROUP BY 1, 2)"


def _mul(x: str, a: int, b: int, k: int = 0) -> str:
    return f"(SELECT vid, j AS dim, sum(val * k.w) AS val FROM {x} x JOIN {_wt(a, b, k)} k ON k.i = x.dim GROUP BY 1, 2)"


def _bn(x: str) -> str:
    return f"(SELECT vid, dim, (val - avg(val) OVER (PARTITION BY dim)) / sqrt(var_pop(val) OVER (PARTITION BY dim) + 1e-5) AS val FROM {x})"


def _re(x: str) -> str:
    return f"(SELECT vid, dim, greatest(val, 0) AS val FROM {x})"


def _lsm(x: str) -> str:
    return f"(SELECT vid, dim, z - ln(sum(exp(z)) OVER (PARTITION BY vid)) AS val FROM (SELECT vid, dim, val - max(val) OVER (PARTITION BY vid) AS z FROM {x}))"


def _plus(x: str, y: str) -> str:
    return f"(SELECT a.vid, a.dim, a.val + b.val AS val FROM {x} a JOIN {y} b USING (vid, dim))"


def _final(x: str, digits: int = 4) -> str:
    return f"SELECT vid, dim, round(val, {digits}) + 0.0 AS val FROM {x}"


def _run(layer, s, d, digits: int = 4) -> DataFrame:
    return long(layer.forward(features(s, d), training=False), digits=digits)


def _gat(x: str, a: int, b: int, k: int) -> str:
    """Attention on x W by the concatenated form; the Spark layer splits the score by end."""
    h = _mul(x, a, b, k)
    score = f"(SELECT e.src, e.dst, sum(CASE WHEN q.i < {b} THEN hs.val ELSE hd.val END * q.w) AS z FROM e JOIN {_wt(2 * b, 1, k)} q ON true JOIN h{k} hs ON hs.vid = e.src AND hs.dim = q.i % {b} JOIN h{k} hd ON hd.vid = e.dst AND hd.dim = q.i % {b} GROUP BY 1, 2)"
    return f", h{k} AS (SELECT * FROM {h}), z{k} AS (SELECT src, dst, CASE WHEN z > 0 THEN z ELSE 0.2 * z END AS s FROM {score}), x{k} AS (SELECT src, dst, exp(s - max(s) OVER (PARTITION BY dst)) AS x FROM z{k}), a{k} AS (SELECT src, dst, x / sum(x) OVER (PARTITION BY dst) AS a FROM x{k}), y{k} AS (SELECT dst AS vid, dim, greatest(sum(a * val), 0) AS val FROM a{k} JOIN h{k} ON vid = src GROUP BY 1, 2) "


query("gcn_layer", _final(_re(_mul(_bn(_agg("f")), 64, 32))))(lambda s, d: _run(Chain(*models.gcn(T.graph(s, d), [64, 32, 10]).steps[:4]), s, d))
query("gcn_two_layer", _final(_lsm(_mul(_agg(_re(_mul(_bn(_agg("f")), 64, 32))), 32, 10, 1))))(lambda s, d: _run(models.gcn(T.graph(s, d), [64, 32, 10]), s, d))
query("gcn_eager_two_layer", _final(_lsm(_agg(_mul(_re(_agg(_mul("f", 64, 32))), 32, 10, 1)))))(lambda s, d: _run(models.gcn_eager(T.graph(s, d), [64, 32, 10]), s, d))
query("gcn_planned_two_layer", _final(_lsm(_mul(_agg(_re(_mul(_agg("f"), 64, 32))), 32, 10, 1))))(lambda s, d: _run(models.gcn_planned(T.graph(s, d), [64, 32, 10]), s, d))
query("gat_layer", _gat("f", 64, 16, 0) + _final("y0"))(lambda s, d: _run(Chain(*models.gat(T.graph(s, d), [64, 16]).steps[:3]), s, d))
query("gat_two_layer", _gat("f", 64, 16, 0) + _gat("y0", 16, 10, 1) + _final(_lsm("y1")))(lambda s, d: _run(models.gat(T.graph(s, d), [64, 16, 10]), s, d))
# the same attention as a user's program, and one with four heads of four elements
query("gat_recorded_two_layer", SQL["gat_two_layer"])(lambda s, d: _run(models.gat_recorded(T.graph(s, d), [64, 16, 10]), s, d))
query(
    "gat_heads_layer",
    f", h AS (SELECT * FROM {_mul('f', 64, 16)}), q AS {_wt(32, 1)}, pl AS (SELECT vid, dim // 4 AS head, sum(val * w) AS p FROM h JOIN q ON i = dim GROUP BY 1, 2), pr AS (SELECT vid, dim // 4 AS head, sum(val * w) AS p FROM h JOIN q ON i = dim + 16 GROUP BY 1, 2)"
    ", z AS (SELECT src, dst, head, CASE WHEN z > 0 THEN z ELSE 0.2 * z END AS s FROM (SELECT src, dst, pl.head, pl.p + pr.p AS z FROM e JOIN pl ON pl.vid = src JOIN pr ON pr.vid = dst AND pr.head = pl.head))"
    ", x AS (SELECT src, dst, head, exp(s - max(s) OVER (PARTITION BY dst, head)) AS x FROM z), a AS (SELECT src, dst, head, x / sum(x) OVER (PARTITION BY dst, head) AS a FROM x)"
    ", y AS (SELECT dst AS vid, dim, greatest(sum(a * val), 0) AS val FROM a JOIN h ON h.vid = src AND dim // 4 = head GROUP BY 1, 2) " + _final("y"),
)(lambda s, d: _run(Chain(*models.gat(T.graph(s, d), [64, 16, 10], heads=4).steps[:2]), s, d))
query("gin_layer", _final(_bn(_re(_re_mul := _mul(_re(_mul(_plus(_agg("f"), "f"), 64, 64)), 64, 32)))))(lambda s, d: _run(Chain(*models.gin(T.graph(s, d), [64, 32, 10]).steps[:6]), s, d))
query("gin_gpu_layer", _final(_bn(_re_mul)))(lambda s, d: _run(Chain(*models.gin(T.graph(s, d), [64, 32], deep=False).steps[:5]), s, d))
query("commnet_layer", _final(_re(_plus(_mul(_agg("f"), 64, 32), _mul("f", 64, 32, 1)))))(lambda s, d: _run(Chain(*models.commnet(T.graph(s, d), [64, 32]).steps[:2]), s, d))

# training and partitioning: loops and files, which SQL can't say


def _train(build, sizes: list[int], s: SparkSession, d: str, epochs: int = 2) -> DataFrame:
    g, v = runner.training_graph(T.graph(s, d)), T.vertices(s, d)
    return training.train(build(g, sizes), v.select("vid", "h"), v.select("vid", "label", "mask"), epochs)


for _name, _sizes in (("gcn", [64, 16, 10]), ("gcn_eager", [64, 16, 10]), ("gat", [64, 16, 10]), ("gin", [64, 16, 10]), ("commnet", [64, 16, 10])):
    query(f"train_{_name}")(lambda s, d, m=_name, z=_sizes: _train(models.MODELS[m], z, s, d))


@query("train_gcn_sampled")
def _sampled(s: SparkSession, d: str) -> DataFrame:
    g, v = runner.training_graph(T.graph(s, d), weights=False), T.vertices(s, d)
    return sampled.train_sampled(g, v.select("vid", "h"), v.select("vid", "label", "mask"), [64, 16, 10], 64, [5, 10], 1)


def _measured(x: str) -> str:
    """Accuracy and loss by mask of log-probabilities x."""
    return (
        f", lp0 AS {x}, am AS (SELECT vid, dim FROM (SELECT vid, dim, row_number() OVER (PARTITION BY vid ORDER BY val DESC, dim) AS r FROM lp0) WHERE r = 1)"
        " SELECT mask, count(*) AS n, CAST(sum(CASE WHEN am.dim = label THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(CASE WHEN am.dim = label THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS accuracy, round(avg(-lp0.val), 4) + 0.0 AS loss"
        " FROM v JOIN am ON am.vid = v.vid JOIN lp0 ON lp0.vid = v.vid AND lp0.dim = v.label GROUP BY mask"
    )


_F4 = ", f4 AS (SELECT vid, dim, round(val, 4) AS val FROM f)"


# the files of a configuration are written from the tables, features with four decimals, and its first epoch is measured
@query("config_run_gpu", _F4 + _measured(_lsm(_mul(_agg(_re(_mul(_agg("f4"), 64, 16))), 16, 10, 1))))
def _config_gpu(s: SparkSession, d: str) -> DataFrame:
    return _config(s, d, "GCN")


@query("config_run", _F4 + _measured(_lsm(_mul(_agg(_re(_mul(_bn(_agg("f4")), 64, 16))), 16, 10, 1))))
def _config(s: SparkSession, d: str, program: str = "GCNCPU") -> DataFrame:
    v, where = T.vertices(s, d), new_path(s, "config")
    write_binary(T.graph(s, d).edges, f"{where}/edges")
    write_vertices(v, f"{where}/features")
    v.select(F.concat_ws(" ", "vid", "label")).write.text(f"{where}/labels")
    v.select(F.concat_ws(" ", "vid", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), F.col("mask") + 1))).write.text(f"{where}/masks")
    lines = {"ALGORITHM": program, "VERTICES": v.count(), "LAYERS": "64-16-10", "EPOCHS": 1, "DROP_RATE": 0.0, "EDGE_FILE": f"{where}/edges", "FEATURE_FILE": f"{where}/features", "LABEL_FILE": f"{where}/labels", "MASK_FILE": f"{where}/masks"}
    config = Config.parse("\n".join(f"{k}:{x}" for k, x in lines.items()))
    out = runner.run(s, config, init=nn.fixed_weight)
    return out.select("mask", "n", "correct", rounded("accuracy", 4).alias("accuracy"), rounded("loss", 4).alias("loss"))


# synthetic graphs, of as many vertices as there are embeddings

_N = "(SELECT n FROM n)"
query("chain_graph", f"SELECT vid AS src, vid + k AS dst FROM v, (SELECT unnest([-1, 1]) AS k) WHERE vid + k BETWEEN 0 AND {_N} - 1")(lambda s, d: generators.chain(s, T.vertices(s, d).count()).edges)
query("segment_graph", f", z AS (SELECT n // 10 AS z FROM n) SELECT vid AS src, vid + k AS dst FROM v, z, (SELECT unnest([-1, 1]) AS k) WHERE vid < z * 10 AND vid + k BETWEEN 0 AND z * 10 - 1 AND vid // z = (vid + k) // z")(
    lambda s, d: generators.segments(s, T.vertices(s, d).count(), 10).edges
)
query("clique_graph", ", z AS (SELECT n // 10 AS z FROM n) SELECT a.vid AS src, b.vid AS dst FROM v a JOIN z ON true JOIN v b ON a.vid // z = b.vid // z AND a.vid <> b.vid WHERE a.vid < z * 10 AND b.vid < z * 10")(
    lambda s, d: generators.cliques(s, T.vertices(s, d).count(), 10).edges
)
query(
    "random_graph",
    f"SELECT vid AS src, CAST((vid + 1 + ((vid * 7907 + 1) % 1000003 + j * 7919) % ({_N} - 1)) % {_N} AS BIGINT) AS dst FROM v, (SELECT unnest(range(1, 9)) AS j) WHERE j <= 1 + (vid * 104729 + 1) % 1000003 % 8",
)(lambda s, d: generators.random_graph(s, T.vertices(s, d).count(), 8).edges)


@query("cut_partition")
def _parts(s: SparkSession, d: str) -> DataFrame:
    """The cut-aware partition in four parts: each part's vertices and edges, and how many of these lead to other parts."""
    g = T.graph(s, d)
    parts = partition(g, 4)
    at = lambda end: parts.select(F.col("vid").alias(end), F.col("part").alias(f"p{end}"))
    e = g.without_self_loops().edges.join(at("src"), "src").join(at("dst"), "dst")
    e = e.groupBy(F.col("psrc").alias("part")).agg(F.count("*").alias("edges"), F.count(F.when(F.col("psrc") != F.col("pdst"), 1)).alias("cut"))
    return parts.groupBy("part").agg(F.count("*").alias("vertices")).join(e, "part", "left")


@query("partition_offsets")
def _bounds(s: SparkSession, d: str) -> DataFrame:
    b = partition_bounds(T.graph(s, d), 4, page=64)
    return s.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(b, b[1:]))], "part int, first long, stop long")


@query("binary_edge_roundtrip", "SELECT src, dst FROM e")
def _binary(s: SparkSession, d: str) -> DataFrame:
    return read_binary(s, write_binary(T.graph(s, d).edges))


@query("weighted_edge_roundtrip", "SELECT src, dst, CAST(CAST(w AS FLOAT) AS DOUBLE) AS w FROM sup")
def _weighted(s: SparkSession, d: str) -> DataFrame:
    return read_binary(s, write_binary(T.supply(s, d), weighted=True), weighted=True)


@query("weighted_file_agg", ", x AS (SELECT dst AS vid, sum(w * (src % 10)) AS a, sum(w * (src % 7)) AS b FROM (SELECT src, dst, CAST(CAST(w AS FLOAT) AS DOUBLE) AS w FROM sup) GROUP BY 1) SELECT vid, 0 AS dim, round(a, 6) + 0.0 AS val FROM x UNION ALL SELECT vid, 1, round(b, 6) + 0.0 FROM x")
def _weighted_sum(s: SparkSession, d: str) -> DataFrame:
    """Sums over the weights of a file."""
    e = _weighted(s, d)
    x = e.select(F.col("src").alias("vid")).distinct().select("vid", F.array((F.col("vid") % 10).cast("double"), (F.col("vid") % 7).cast("double")).alias("h"))
    return long(M.Aggregate(Graph(e.select(F.col("dst").alias("vid")).distinct(), e.select("src", "dst")), 2, e).forward(x))


def _numbered_files(s: SparkSession, d: str) -> str:
    """The tables as the files of a numbered data set, and the files that training reads, made from these."""
    v, where = T.vertices(s, d), new_path(s, "numbered")
    lines = v.select("vid", F.array_join(F.transform("h", lambda x: F.format_string("%.4f", x)), ",").alias("f"), F.col("label").cast("string").alias("y"), "mask")
    # line numbers are places in files by name: one range of vertices a file
    ordered = lines.repartitionByRange(4, "vid").sortWithinPartitions("vid")
    ordered.select("f").write.text(f"{where}/lines")
    ordered.select("y").write.text(f"{where}/classes")
    splits = {word: f"{where}/{word}" for word in ("train", "val", "test")}
    for k, path in enumerate(splits.values()):
        v.filter(F.col("mask") == k).select(F.col("vid").cast("string")).write.text(path)
    T.plain_graph(s, d).edges.select(F.concat_ws(",", "src", "dst")).write.text(f"{where}/pairs")
    prepare_numbered(s, f"{where}/pairs", f"{where}/lines", f"{where}/classes", splits, f"{where}/ready")
    return f"{where}/ready"


@query("numbered_flow_edges", "SELECT src, dst FROM e0 WHERE src <> dst UNION SELECT dst, src FROM e0 WHERE src <> dst UNION SELECT vid, vid FROM v")
def _flow_edges(s: SparkSession, d: str) -> DataFrame:
    return read_binary(s, f"{_numbered_files(s, d)}/edges")


@query("numbered_flow_vertices", "SELECT f.vid, label, mask, dim, round(round(val, 4), 6) + 0.0 AS val FROM f JOIN v ON v.vid = f.vid")
def _flow_vertices(s: SparkSession, d: str) -> DataFrame:
    where = _numbered_files(s, d)
    return long(read_vertices(s, f"{where}/features", f"{where}/labels", f"{where}/masks"), "vid", "label", "mask")


@query("checkpoint_roundtrip", "SELECT vid, dim, round(val, 6) + 0.0 AS val FROM f")
def _checkpoint(s: SparkSession, d: str) -> DataFrame:
    return long(training.cut(features(s, d)))
