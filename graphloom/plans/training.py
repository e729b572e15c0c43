"""Training loops: Spark does the passes over vertices and edges, the driver holds the dense weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nn
from ..functions.optim import Adam
from ..sources.shared import cut, discard
from .layers import Dropout, Layer, gradients, loss_gradient

MEASURED = "mask int, n long, correct long, accuracy double, loss double"


def measure(out: DataFrame, truth: DataFrame) -> list[tuple]:
    """(mask, n, correct, accuracy, loss) of log-probabilities, by mask, in one pass."""
    seen = out.join(truth, "vid")
    hit = (nn.argmax(F.col("h")) == F.col("label")).cast("long")
    loss = F.avg(-F.col("h")[F.col("label").cast("int")])
    rows = seen.groupBy("mask").agg(F.count("*").alias("n"), F.sum(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy"), loss.alias("loss"))
    return [tuple(r) for r in rows.orderBy("mask").collect()]


def step(model: Layer, optimiser, out: DataFrame, truth: DataFrame, n: int) -> None:
    """One update of the weights from the outputs of a forward pass over the n rows of mask 0."""
    model.backward(loss_gradient(out, truth, n=n), wanted=False)
    layers = model.learned()
    flat = lambda kind: {(i, k): v for i, own in enumerate(kind) for k, v in own.items()}
    for (i, k), w in optimiser.update(flat([p.weights for p in layers]), flat(gradients(layers))).items():
        layers[i].weights[k] = w
    model.release()


class State:
    """Where a training stands: a table of weights and of the optimiser's moments, a row for each array, below `path` for each epoch. An
    epoch counts once its table is complete, so a lost driver costs the epoch that it was in."""

    SCHEMA = "layer int, name string, kind string, shape array<int>, values array<double>, step long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _done(self, epoch: int) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={epoch}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def last(self) -> int | None:
        """The last epoch of which there is a complete table."""
        epoch = 0
        while self._done(epoch):
            epoch += 1
        return epoch - 1 if epoch else None

    def save(self, epoch: int, model: Layer, optimiser) -> None:
        arrays = [(i, k, "weight", w) for i, p in enumerate(model.learned()) for k, w in p.weights.items()]
        arrays += [(i, k, kind, v) for kind in ("m", "v") for (i, k), v in getattr(optimiser, kind, {}).items()]
        rows = [(i, k, kind, list(v.shape), v.ravel().tolist(), getattr(optimiser, "step", 0)) for i, k, kind, v in arrays]
        self.spark.createDataFrame(rows, self.SCHEMA).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def restore(self, epoch: int, model: Layer, optimiser) -> None:
        """Weights, moments, steps and dropout's draws as they were after that epoch."""
        layers = model.learned()
        for r in self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/epoch={epoch}").collect():
            value = np.array(r["values"]).reshape(r["shape"])
            if r["kind"] == "weight":
                layers[r["layer"]].weights[r["name"]] = value
            else:
                getattr(optimiser, r["kind"])[r["layer"], r["name"]] = value
            if hasattr(optimiser, "step"):
                optimiser.step = r["step"]
        for p in model.layers():
            if isinstance(p, Dropout):
                p.epoch = epoch + 1


def train(model: Layer, x: DataFrame, truth: DataFrame, epochs: int, optimiser=None, state: str | None = None) -> DataFrame:
    """x(vid, h), truth(vid, label, mask) -> (epoch, mask, n, correct, accuracy, loss), measured before each update; mask 0 trains. With a
    folder for its state, training goes on after the last epoch that is found there, and only further epochs are run and measured."""
    spark, optimiser, rows, held = x.sparkSession, optimiser or Adam(), [], []
    kept, first = State(spark, state) if state else None, 0
    if kept and (last := kept.last()) is not None:
        kept.restore(last, model, optimiser)
        first = last + 1
    x, truth = cut(x), cut(truth)
    n = truth.filter("mask = 0").count()
    for epoch in range(first, epochs):
        out = cut(model.forward(x, training=True), held=held)
        rows += [(epoch, *r) for r in measure(out, truth)]
        step(model, optimiser, out, truth, n)
        discard(spark, held)
        if kept:
            kept.save(epoch, model, optimiser)
    return spark.createDataFrame(rows, f"epoch int, {MEASURED}")
