"""A training configuration, run from its files to its accuracies."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nn import xavier
from ..functions.optim import Adam
from ..operators.graph import Graph
from ..sources.edge_files import read_binary
from ..sources.vertex_files import Config, read_vertices
from . import models, training
from .sampled import train_sampled

#: The names of programs in configuration files, and the model of each.
PROGRAMS = {
    "GCNCPU": models.gcn,
    "GCN": partial(models.gcn, norm=False),
    "GCNCPUEAGER": models.gcn_eager,
    "GCNEAGER": models.gcn_eager,
    "GCNEAGERSINGLE": models.gcn_eager,
    "GCNSAMPLESINGLE": models.gcn,
    "GATCPU": models.gat,
    "GATCPUDIST": models.gat,
    "GATGPUDIST": models.gat,
    "GINCPU": models.gin,
    "GINGPU": partial(models.gin, deep=False),
    "COMMNETGPU": models.commnet,
}
SAMPLED = {"GCNSAMPLESINGLE"}
#: Programs with dropout.
DROPS = {"GCNCPU", "GCN", "GCNCPUEAGER", "GCNEAGER", "GCNEAGERSINGLE", "GCNSAMPLESINGLE"}


def run(spark: SparkSession, config: Config, init=None) -> DataFrame:
    """The measures of train() or, for a program that samples, of train_sampled() with the first fanouts, one a layer. Weights are drawn by Xavier unless init is given."""
    if config.algorithm not in PROGRAMS:
        raise ValueError(f"no program {config.algorithm!r}; known: {', '.join(sorted(PROGRAMS))}")
    build = PROGRAMS[config.algorithm]
    options = {"init": init or (lambda a, b, k: xavier(a, b, k)), **({"rate": config.drop_rate} if config.algorithm in DROPS else {})}
    v = read_vertices(spark, config.feature_file, config.label_file, config.mask_file or None)
    g = training_graph(Graph(spark.range(config.vertices).withColumnRenamed("id", "vid"), read_binary(spark, config.edge_file)))
    x, truth = v.select("vid", "h"), v.select("vid", "label", "mask")
    optimiser = Adam(rate=config.learn_rate, decay=config.weight_decay, decay_rate=config.decay_rate, decay_epoch=config.decay_epoch)
    sizes = list(config.layers)
    if config.algorithm in SAMPLED:
        return train_sampled(g, x, truth, sizes, config.batch_size, list(config.fanout), config.epochs, optimiser, **options)
    return training.train(build(g, sizes, **options), x, truth, config.epochs, optimiser)


def training_graph(g: Graph, weights: bool = True) -> Graph:
    """The graph with its tables and weights (if they are used) written once, as every epoch reads them."""
    own = Graph(training.cut(g.vertices), training.cut(g.edges.select(F.col("src"), F.col("dst"))))
    if weights:
        own.__dict__["norm_weights"] = training.cut(own.norm_weights)
    return own
