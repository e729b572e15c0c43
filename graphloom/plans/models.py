"""Model programs as chains of layers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..functions.nn import fixed_weight
from ..operators.graph import Graph
from ..operators.messages import norm_aggregate
from .layers import Attention, BatchNorm, Chain, Dropout, Gather, Layer, Linear, LogSoftmax, Relu, Same, Sum
from .tape import Recorded, attention

Init = Callable[[int, int, int], np.ndarray]


def _pairs(sizes: list[int]) -> list[tuple[int, int, bool]]:
    return [(a, b, i == len(sizes) - 2) for i, (a, b) in enumerate(zip(sizes, sizes[1:]))]


def gcn(graph: Graph, sizes: list[int], init: Init = fixed_weight, rate: float = 0.0, norm: bool = True) -> Layer:
    """Hidden layers: dropout(relu(BN(Agg x) W)); the last: Agg x W."""
    steps: list[Layer] = []
    for i, (a, b, last) in enumerate(_pairs(sizes)):
        steps.append(Gather(norm_aggregate(graph, a)))
        if norm and not last:
            steps.append(BatchNorm(a))
        steps.append(Linear(init(a, b, i)))
        if not last:
            steps += [Relu(), Dropout(rate, i)]
    return Chain(*steps, LogSoftmax())


def gcn_eager(graph: Graph, sizes: list[int], init: Init = fixed_weight, rate: float = 0.0) -> Layer:
    """Transform before aggregating, which moves less where a layer narrows: Agg(x W), then dropout and relu before the next."""
    steps: list[Layer] = []
    for i, (a, b, _) in enumerate(_pairs(sizes)):
        if i:
            steps += [Dropout(rate, i), Relu()]
        steps += [Linear(init(a, b, i)), Gather(norm_aggregate(graph, b))]
    return Chain(*steps, LogSoftmax())


def gcn_planned(graph: Graph, sizes: list[int], init: Init = fixed_weight) -> Layer:
    """A GCN without batch norm, each layer in the order that aggregates the narrower vectors. Both orders give the same result, as nothing
    nonlinear stands between them."""
    steps: list[Layer] = []
    for i, (a, b, last) in enumerate(_pairs(sizes)):
        w = Linear(init(a, b, i))
        steps += [w, Gather(norm_aggregate(graph, b))] if b < a else [Gather(norm_aggregate(graph, a)), w]
        if not last:
            steps.append(Relu())
    return Chain(*steps, LogSoftmax())


def gat(graph: Graph, sizes: list[int], init: Init = fixed_weight, heads: int = 1) -> Layer:
    """h = x W; y = relu(attention over in-edges). Several heads share out the elements of h; the last layer has one."""
    steps: list[Layer] = []
    for i, (a, b, last) in enumerate(_pairs(sizes)):
        att = init(2 * b, 1, i).ravel()
        if heads > 1 and not last:
            steps += [Recorded(graph, a, {"w": init(a, b, i), "al": att[:b], "ar": att[b:]}, attention(heads)), Relu()]
        else:
            steps += [Linear(init(a, b, i)), Attention(graph, att[:b], att[b:]), Relu()]
    return Chain(*steps, LogSoftmax())


def gat_recorded(graph: Graph, sizes: list[int], init: Init = fixed_weight) -> Layer:
    """The same as gat(), from a program whose gradients are derived."""
    steps: list[Layer] = []
    for i, (a, b, _) in enumerate(_pairs(sizes)):
        att = init(2 * b, 1, i).ravel()
        steps += [Recorded(graph, a, {"w": init(a, b, i), "al": att[:b], "ar": att[b:]}, attention()), Relu()]
    return Chain(*steps, LogSoftmax())


def gin(graph: Graph, sizes: list[int], init: Init = fixed_weight, deep: bool = True) -> Layer:
    """BN(relu(relu((Agg x + x) P0) P1)) in hidden layers, without the outer relu in the last; not deep: without it in any."""
    steps: list[Layer] = []
    for i, (a, b, last) in enumerate(_pairs(sizes)):
        steps += [Sum(Gather(norm_aggregate(graph, a)), Same()), Linear(init(a, a, i)), Relu(), Linear(init(a, b, i))]
        steps += [Relu()] * (deep and not last) + [BatchNorm(b)]
    return Chain(*steps, LogSoftmax())


def commnet(graph: Graph, sizes: list[int], init: Init = fixed_weight) -> Layer:
    """relu(Agg x P0 + x P1); the scores are rectified before the last log-softmax, too."""
    steps: list[Layer] = []
    for i, (a, b, _) in enumerate(_pairs(sizes)):
        steps += [Sum(Chain(Gather(norm_aggregate(graph, a)), Linear(init(a, b, i))), Linear(init(a, b, i + 1))), Relu()]
    return Chain(*steps, LogSoftmax())


def gat_heads(graph: Graph, sizes: list[int], init: Init = fixed_weight) -> Layer:
    return gat(graph, sizes, init, heads=2)


MODELS = {"gcn": gcn, "gcn_eager": gcn_eager, "gat": gat, "gat_recorded": gat_recorded, "gat_heads": gat_heads, "gin": gin, "commnet": commnet}
