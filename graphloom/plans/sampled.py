"""Training on sampled blocks. A batch is bounded by its seeds and fanouts, so it becomes one row: its edges by hop with local ids, the
features of its deepest sources, and the labels of its seeds. Batches are sampled and packed by one pass of joins an epoch. An update needs the
weights of the one before it: with one batch an update, a run of AHEAD updates is one job, whose task goes through them in order and hands
the weights on; with several, one job works out the gradients of all batches of an update, each in the task that holds its row."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nn import fixed_weight
from ..functions.optim import Adam
from ..operators.blocks import numbered_seeds, sample_blocks, sources_of
from ..operators.graph import Graph
from ..operators.sampling import seed_batches
from ..sources.shared import cut, discard

#: Batches that one task goes through, one after another.
AHEAD = 64
MEASURED = "mask int, n long, correct long, accuracy double, loss double"


def pack(blocks: DataFrame, batches: DataFrame, x: DataFrame, truth: DataFrame, hops: int) -> DataFrame:
    """(batch_id, edges, deep, seeds), a row for each batch."""
    in_order = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    edges = blocks.groupBy("batch_id").agg(in_order("hop", "dst_local", "src_local", "src", "w").alias("edges"))
    deep = sources_of(blocks, hops - 1).join(x.select("vid", "h"), "vid").groupBy("batch_id").agg(in_order("local", "h").alias("deep"))
    seeds = numbered_seeds(batches).join(truth.select("vid", F.col("label").cast("long").alias("label")), "vid").groupBy("batch_id").agg(in_order("local", "vid", "label").alias("seeds"))
    return seeds.join(edges, "batch_id").join(deep, "batch_id")


@dataclass
class Batch:
    """A packed batch: arrays of edges by hop, names of the sources of each hop, features, and the seeds."""

    id: int
    dst: list[np.ndarray]
    src: list[np.ndarray]
    w: list[np.ndarray]
    names: list[np.ndarray]
    x: np.ndarray
    vid: np.ndarray
    label: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, hops: int) -> Iterator[Batch]:
        for i, number in enumerate(batch.column("batch_id").to_pylist()):
            edges, deep, seeds = (batch.column(c)[i].values for c in ("edges", "deep", "seeds"))
            field = lambda a, k: a.field(k).to_numpy(zero_copy_only=False)
            hop = field(edges, "hop")
            part = lambda k: [field(edges, k)[hop == j] for j in range(hops)]
            src, names = part("src_local"), []
            for s, vid in zip(src, part("src")):
                own = np.empty(s.max(initial=-1) + 1, np.int64)
                own[s] = vid
                names.append(own)
            yield cls(number, part("dst_local"), src, part("w"), names, deep.field("h").flatten().to_numpy().reshape(len(deep), -1), field(seeds, "vid"), field(seeds, "label"))

    def size(self, hop: int) -> int:
        """Destinations of a hop."""
        return len(self.names[hop - 1]) if hop else len(self.vid)

    def gather(self, hop: int, x: np.ndarray) -> np.ndarray:
        y = np.zeros((self.size(hop), x.shape[1]))
        np.add.at(y, self.dst[hop], self.w[hop][:, None] * x[self.src[hop]])
        return y

    def spread(self, hop: int, g: np.ndarray) -> np.ndarray:
        """The adjoint of gather()."""
        x = np.zeros((len(self.names[hop]), g.shape[1]))
        np.add.at(x, self.src[hop], self.w[hop][:, None] * g[self.dst[hop]])
        return x


def kept(vid: np.ndarray, width: int, rate: float, salt: int) -> np.ndarray:
    """Factors of dropout, hashed from vertex and element."""
    keep = (vid[:, None] * 7919 + np.arange(width) * 104729 + salt) % 1000003 >= rate * 1000003
    return keep / (1 - rate)


def run_batch(b: Batch, weights: list[np.ndarray], rate: float = 0.0, step: int = 0) -> tuple[np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]:
    """(log-probabilities of the seeds, the function from their gradient to those of the weights): relu(Agg x W) in hidden layers, with dropout
    before the next; layer l of L walks hop L - 1 - l."""
    last, x, trail = len(weights) - 1, b.x, []
    for layer, w in enumerate(weights):
        hop = last - layer
        keep = kept(b.names[hop], x.shape[1], rate, layer * 31 + step * 17) if layer and rate else None
        y = b.gather(hop, x if keep is None else x * keep)
        z = y @ w
        trail.append((hop, keep, y, z))
        x = np.maximum(z, 0) if layer < last else z
    top = x - x.max(1, keepdims=True)
    out = top - np.log(np.exp(top).sum(1, keepdims=True))

    def back(g: np.ndarray) -> list[np.ndarray]:
        g, grads = g - np.exp(out) * g.sum(1, keepdims=True), []
        for layer in range(last, -1, -1):
            hop, keep, y, _ = trail[layer]
            grads.append(y.T @ g)
            if layer:
                g = b.spread(hop, g @ weights[layer].T)
                g = (g if keep is None else g * keep) * (trail[layer - 1][3] > 0)
        return grads[::-1]

    return out, back


def loss_gradient(out: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    g = np.zeros_like(out)
    g[np.arange(len(label)), label] = -1 / n
    return g


def _outputs(weights: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in Batch.read(batch, len(weights)):
                out, _ = run_batch(b, weights)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), b.id)), pa.array(b.vid), pa.array(list(out), pa.list_(pa.float64()))], ["batch_id", "vid", "h"])

    return run


def outputs(packed: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """(batch_id, vid, h): log-probabilities of the seeds of each batch, without dropout."""
    return packed.mapInArrow(_outputs(weights), "batch_id long, vid long, h array<double>")


def _gradients(weights: list[np.ndarray], rate: float, step: int, n: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in Batch.read(batch, len(weights)):
                out, back = run_batch(b, weights, rate, step)
                picked = out[np.arange(len(out)), b.label]
                grads = back(loss_gradient(out, b.label, n or len(out)))
                yield pa.RecordBatch.from_pydict({
                    "batch_id": pa.array([b.id]), "n": pa.array([len(out)]), "correct": pa.array([int((out.argmax(1) == b.label).sum())]), "loss": pa.array([-picked.sum()]),
                    "grads": pa.array([np.concatenate([g.ravel() for g in grads])], pa.list_(pa.float64())),
                })

    return run


def batch_gradients(packed: DataFrame, weights: list[np.ndarray], rate: float = 0.0, step: int = 0, n: int | None = None) -> DataFrame:
    """(batch_id, n, correct, loss, grads): a row for each batch, grads being all weights' one after another, loss a sum over its seeds.
    The gradient is that of the mean over n seeds (those of the batch if none is given)."""
    return packed.mapInArrow(_gradients(weights, rate, step, n), "batch_id long, n long, correct long, loss double, grads array<double>")


def _updates(weights: list[np.ndarray], optimiser, rate: float, step: int):
    """Updates by one batch each, in the order of the rows: what each measured, and a last row with the weights and the optimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, moves, at = weights, copy.deepcopy(optimiser), step
        kinds = {"batch_id": pa.int64(), "n": pa.int64(), "correct": pa.int64(), "loss": pa.float64(), "state": pa.binary()}
        row = lambda *values: pa.RecordBatch.from_pydict({k: pa.array([v], t) for (k, t), v in zip(kinds.items(), values)})
        for batch in batches:
            for b in Batch.read(batch, len(own)):
                out, back = run_batch(b, own, rate, at)
                picked = out[np.arange(len(out)), b.label]
                yield row(b.id, len(out), int((out.argmax(1) == b.label).sum()), float(-picked.sum()), None)
                moved = moves.update(dict(enumerate(own)), dict(enumerate(back(loss_gradient(out, b.label, len(out))))))
                own, at = [moved[k] for k in range(len(own))], at + 1
        yield row(None, None, None, None, pickle.dumps((own, moves)))

    return run


def _measured(weights: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in Batch.read(batch, len(weights)):
                out, _ = run_batch(b, weights)
                picked = out[np.arange(len(out)), b.label]
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(out)]), "correct": pa.array([int((out.argmax(1) == b.label).sum())]), "loss": pa.array([-picked.sum()])})

    return run


def unpack(flat: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
    ends = np.cumsum([r * c for r, c in shapes])
    return [part.reshape(s) for part, s in zip(np.split(np.asarray(flat), ends[:-1]), shapes)]


class Sampler:
    """The batches of one mask, sampled anew for each epoch."""

    def __init__(self, graph: Graph, x: DataFrame, truth: DataFrame, mask: int, batch_size: int, fanouts: list[int]):
        self.graph, self.x, self.truth, self.fanouts = graph, x, truth, fanouts
        self.batches = cut(seed_batches(truth.filter(F.col("mask") == mask).select("vid"), batch_size))
        self.sizes = {r["batch_id"]: r["n"] for r in self.batches.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}

    def packed(self, epoch: int, held: list[str]) -> DataFrame:
        blocks = cut(sample_blocks(self.graph, self.batches, self.fanouts, seed=epoch * len(self.fanouts)), held=held)
        return pack(blocks, self.batches, self.x, self.truth, len(self.fanouts))

    def runs(self, epoch: int) -> Iterator[tuple[list[int], DataFrame]]:
        """(ids, packed batches): AHEAD batches at a time, out of one table in the order of batches."""
        held, spark = [], self.x.sparkSession
        rows = cut(self.packed(epoch, held).repartitionByRange("batch_id").sortWithinPartitions("batch_id"), held=held)
        for first in range(0, len(self.sizes), AHEAD):
            yield [i for i in range(first, first + AHEAD) if i in self.sizes], rows.filter(F.col("batch_id").between(first, first + AHEAD - 1))
        discard(spark, held)

    def measured(self, epoch: int, weights: list[np.ndarray]) -> tuple:
        """(n, correct, loss) of all batches; their features are never written."""
        held = []
        r = self.packed(epoch, held).mapInArrow(_measured(weights), "n long, correct long, loss double").agg(F.sum("n"), F.sum("correct"), F.sum("loss")).first()
        discard(self.x.sparkSession, held)
        return tuple(v or 0 for v in r)


def train_sampled(
    graph: Graph, x: DataFrame, truth: DataFrame, sizes: list[int], batch_size: int, fanouts: list[int], epochs: int,
    optimiser=None, init=fixed_weight, rate: float = 0.0, workers: int = 1,
) -> DataFrame:
    """Mini-batch training of a GCN without batch norm. Each update takes `workers` consecutive batches of training vertices (mask 0), whose
    gradients are averaged over their seeds. After an epoch, the vertices of masks 1 and 2 are sampled in batches, too, and measured with
    the weights as they are, without dropout or update. A fanout for each layer is used, the first for the seeds; further ones are
    ignored. (epoch, batch, mask, n, correct, accuracy, loss), by batch for mask 0; batch is null for the others."""
    layers = len(sizes) - 1
    if len(fanouts) < layers:
        raise ValueError(f"{layers} layers need as many fanouts, not {len(fanouts)}")
    spark, optimiser, rows, step = x.sparkSession, optimiser or Adam(), [], 0
    x, truth = cut(x), cut(truth)
    samplers = {mask: Sampler(graph, x, truth, mask, batch_size, fanouts[:layers]) for mask in (0, 1, 2)}
    weights = [init(a, b, i) for i, (a, b) in enumerate(zip(sizes, sizes[1:]))]
    for epoch in range(epochs):
        for ids, packed in samplers[0].runs(epoch):
            if workers == 1:
                found = packed.coalesce(1).sortWithinPartitions("batch_id").mapInArrow(_updates(weights, optimiser, rate, step), "batch_id long, n long, correct long, loss double, state binary").collect()
                weights, moved = next(pickle.loads(r["state"]) for r in found if r["state"] is not None)
                optimiser.__dict__.update(moved.__dict__)
                rows += [(epoch, r["batch_id"], 0, r["n"], r["correct"], r["correct"] / r["n"], r["loss"] / r["n"]) for r in found if r["state"] is None]
                step += len(ids)
                continue
            for i in range(0, len(ids), workers):
                own = ids[i : i + workers]
                n = sum(samplers[0].sizes[b] for b in own)
                found = batch_gradients(packed.filter(F.col("batch_id").between(own[0], own[-1])), weights, rate, step, n).orderBy("batch_id").collect()
                rows += [(epoch, r["batch_id"], 0, r["n"], r["correct"], r["correct"] / r["n"], r["loss"] / r["n"]) for r in found]
                grads = unpack(sum(np.array(r["grads"]) for r in found), [w.shape for w in weights])
                moved = optimiser.update(dict(enumerate(weights)), dict(enumerate(grads)))
                weights, step = [moved[k] for k in range(layers)], step + 1
        for mask in (1, 2):
            n, correct, loss = samplers[mask].measured(epoch, weights) if samplers[mask].sizes else (0, 0, 0)
            if n:
                rows.append((epoch, None, mask, int(n), int(correct), float(correct / n), float(loss / n)))
    return spark.createDataFrame(rows, f"epoch int, batch long, {MEASURED}")
