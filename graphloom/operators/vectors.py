"""Vertex tensors: (vid, h) with h an array of doubles, and the long form (vid, dim, val)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors up to this width are folded by one aggregate per element in a single row per key; wider ones in parts of this width.
WIDE = 256


def to_long(x: DataFrame, key: str | Sequence[str] = "vid", vec: str = "h") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return x.select(*keys, F.posexplode(vec).alias("dim", "val"))


def to_vectors(x: DataFrame, key: str = "vid") -> DataFrame:
    return x.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "val"))), lambda s: s.val).alias("h"))


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def sum_vectors(m: DataFrame, key: str | Sequence[str], width: int, vec: str = "m", weight: Column | None = None) -> DataFrame:
    """(key, h): the (weighted) sum of vectors per key, combined on the map side."""
    w = F.lit(1.0) if weight is None else weight
    return fold_vectors(m.withColumn("__w", w), key, width, lambda c: F.sum(F.col("__w") * c), vec)


def fold_vectors(m: DataFrame, key: str | Sequence[str] | None, width: int, fold, vec: str = "m") -> DataFrame:
    """(key, h): an aggregate of each element per key (one column or several), or over all rows without a key. An edge with a wide vector becomes a row for
    each part of it, never one for each element."""
    keys = [key] if isinstance(key, str) else list(key or ())
    whole = lambda v, n: F.array(*[fold(v[i]) for i in range(n)])
    if width <= WIDE:
        return m.groupBy(*keys).agg(whole(F.col(vec), width).alias("h"))
    starts = F.transform(F.sequence(F.lit(1), F.lit(width), F.lit(WIDE)), lambda i: F.slice(vec, i, F.lit(WIDE)))
    parts = m.select(*[c for c in m.columns if c != vec], F.posexplode(starts).alias("__part", "__v"))
    # elements that the last part lacks fold to null, and are cut off
    parts = parts.groupBy(*keys, "__part").agg(F.array(*[fold(F.get("__v", F.lit(i))) for i in range(WIDE)]).alias("h"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__part", "h"))), lambda p: p.h))
    return parts.groupBy(*keys).agg(F.slice(joined, 1, width).alias("h"))


def over_vertices(vertices: DataFrame, x: DataFrame, key: str, width: int) -> DataFrame:
    """(vid, h) for every vertex; those without a row get zeros."""
    x = x.select(F.col(key).alias("vid"), "h")
    return vertices.select("vid").join(x, "vid", "left").select("vid", F.coalesce("h", zeros(width)).alias("h"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def dot(a: Column, b: Column, width: int | None = None) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def running_sum(df: DataFrame, key: str, value: str, out: str, chunk: int = 1 << 16, group: Sequence[str] = ()) -> DataFrame:
    """Exclusive running sum of `value` in the order of the integer `key` (in each group, if columns are given). Sums run within chunks of
    the key range and over the chunks' totals, so no task sees more than a chunk or one row per chunk."""
    d = df.withColumn("__c", F.floor(F.col(key) / chunk))
    before = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*group, "__c").agg(F.sum(value).alias("__t"))
    base = totals.select(*group, "__c", F.coalesce(F.sum("__t").over(before(*group).orderBy("__c")), F.lit(0)).alias("__b"))
    own = F.coalesce(F.sum(value).over(before(*group, "__c").orderBy(key)), F.lit(0))
    return d.withColumn("__o", own).join(base, [*group, "__c"]).withColumn(out, F.col("__b") + F.col("__o")).drop("__c", "__b", "__o")
