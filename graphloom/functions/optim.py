"""Optimisers for the dense weights, which live on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Adam:
    """Adam with L2 decay and a learning rate that falls by `decay_rate` every `decay_epoch` steps. With compat, the moments use
    the decayed powers of the betas as their coefficients and decay_rate is cut to an integer."""

    rate: float = 0.01
    decay: float = 1e-4
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-9
    decay_rate: float = 0.97
    decay_epoch: int = 0
    compat: bool = False
    step: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def _moved(self, name, w: np.ndarray, g: np.ndarray, b1: float, b2: float, rate: float, bias: tuple[float, float]) -> np.ndarray:
        g = g + self.decay * w
        self.m[name] = b1 * self.m.get(name, 0.0) + (1 - b1) * g
        self.v[name] = b2 * self.v.get(name, 0.0) + (1 - b2) * g * g
        return w - rate * (self.m[name] / bias[0]) / (np.sqrt(self.v[name] / bias[1]) + self.eps)

    def update(self, weights: dict, grads: dict) -> dict:
        base = self.rate
        if self.decay_epoch:
            share = int(self.decay_rate) if self.compat else self.decay_rate
            base *= float(share) ** (self.step // self.decay_epoch)
        if self.compat:
            # step t finds alpha and the betas as the schedule left them after t steps
            b1, b2 = self.beta1 ** (self.step + 1), self.beta2 ** (self.step + 1)
            rate = base if not self.step else base * np.sqrt(1 - self.beta2**self.step) / (1 - self.beta1**self.step)
            out = {k: self._moved(k, w, grads[k], b1, b2, rate, (1.0, 1.0)) for k, w in weights.items()}
        else:
            t = self.step + 1
            bias = (1 - self.beta1**t, 1 - self.beta2**t)
            out = {k: self._moved(k, w, grads[k], self.beta1, self.beta2, base, bias) for k, w in weights.items()}
        self.step += 1
        return out


@dataclass
class SGD:
    rate: float = 0.01
    decay: float = 1e-4

    def update(self, weights: dict, grads: dict) -> dict:
        return {k: (w - self.rate * grads[k]) * (1 - self.decay) for k, w in weights.items()}
