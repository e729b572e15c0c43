"""Dense layers and losses on vertex tensors (vid, h). Small dense weights are literals of the expression or arrays in a closure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-5


def fixed_weight(rows: int, cols: int, k: int = 0) -> np.ndarray:
    """A deterministic weight of the scale of a Xavier-uniform draw."""
    i, j = np.arange(rows)[:, None], np.arange(cols)[None, :]
    return np.sqrt(6 / (rows + cols)) * np.sin(0.37 * i + 0.11 * j + 0.5 * k)


def xavier(rows: int, cols: int, seed: int = 0) -> np.ndarray:
    s = np.sqrt(6 / (rows + cols))
    return np.random.default_rng(seed).uniform(-s, s, (rows, cols))


def linear(x: DataFrame, w: np.ndarray, vec: str = "h") -> DataFrame:
    """x W, in Arrow batches: one matrix product per batch, whose rows never become objects. Null vectors stay null. Other columns stay."""
    width, cols = w.shape

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def product(h: pa.Array) -> pa.Array:
        y = h.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) @ w
        there = h.is_valid().to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(there))).astype(np.int32) * np.int32(cols)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(y.ravel()), mask=pa.array(~there))

    return x.withColumn(vec, product(vec))


def relu(h: Column) -> Column:
    return F.transform(h, lambda v: F.greatest(v, F.lit(0.0)))


def leaky(v: Column, slope: float = 0.2) -> Column:
    return F.when(v > 0, v).otherwise(v * slope)


def log_softmax(h: Column) -> Column:
    top = F.array_max(h)
    total = F.log(F.aggregate(F.transform(h, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))
    return F.transform(F.array(F.struct(top.alias("top"), total.alias("total"))), lambda c: F.transform(h, lambda v: v - c.top - c.total))[0]


def argmax(h: Column) -> Column:
    """The first place of the largest element."""
    return (F.array_position(h, F.array_max(h)) - 1).cast("int")


def batch_statistics(x: DataFrame, width: int, vec: str = "h") -> DataFrame:
    """One row: the mean and the biased variance of each element (zeros of `width` over no rows). One aggregate takes whole vectors,
    so its plan is as short for wide ones."""
    s = x.agg(F.count(vec).alias("n"), Summarizer.metrics("mean", "variance").summary(array_to_vector(vec)).alias("s"))
    none = F.array_repeat(F.lit(0.0), width)
    mean, spread = (F.when(F.col("n") > 0, vector_to_array(F.col(f"s.{k}"))).otherwise(none) for k in ("mean", "variance"))
    return s.select(mean.alias("mu"), F.transform(spread, lambda v: v * (F.col("n") - 1) / F.greatest("n", F.lit(1))).alias("va"))


def batch_norm(x: DataFrame, width: int, eps: float = EPS) -> DataFrame:
    """(h - mean) / sqrt(variance + eps) per element over all vertices; statistics are one row, so their size is bounded."""
    z = F.zip_with(F.zip_with("h", "mu", lambda a, b: a - b), "va", lambda a, v: a / F.sqrt(v + eps))
    return x.join(F.broadcast(batch_statistics(x, width))).withColumn("h", z).drop("mu", "va")


def keep_mask(seed: int, epoch: int, layer: int, rate: float) -> Column:
    """(vid, dim)-wise dropout decisions by an arithmetic hash, so that a backward pass can replay them: true keeps."""
    return (F.col("vid") * 7919 + F.col("dim") * 104729 + (seed * 31 + epoch * 17 + layer)) % 1000003 >= rate * 1000003


def dropout(h: Column, vid: Column, rate: float, seed: int = 0, epoch: int = 0, layer: int = 0) -> Column:
    salt = seed * 31 + epoch * 17 + layer
    return F.transform(h, lambda v, i: F.when((vid * 7919 + i * 104729 + salt) % 1000003 >= rate * 1000003, v / (1 - rate)).otherwise(0.0))


def nll(x: DataFrame, label: str = "label") -> DataFrame:
    """(vid, h = log-probabilities, label) -> one row, the mean loss."""
    return x.agg(F.avg(-F.col("h")[F.col(label).cast("int")]).alias("loss"))


def accuracy(x: DataFrame, by: str = "mask", label: str = "label") -> DataFrame:
    """(mask, n, correct, accuracy) of (vid, h, label, mask)."""
    hit = (argmax(F.col("h")) == F.col(label)).cast("long")
    return x.groupBy(by).agg(F.count("*").alias("n"), F.sum(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy"))
