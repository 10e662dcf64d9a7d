"""Models that can be trained on shards, and the built-in logistic regression.

A model plugs in with start parameters, three methods that train on a stream of rows
(NumPy, inside a Spark task), and a score as a column expression. All alphas of a grid
train on the same stream at once.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column

from ledgerweave.functions.scoring import logit, probability
from ledgerweave.settings import INTERCEPT_DECAY, LEARNING_RATE, FeatureSpec

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shard:
    """Encoded rows one task trains on: scaled numerics, active feature indices (-1 for
    an unknown category) and 0/1 labels, in a fixed row order."""

    num: np.ndarray
    cat: np.ndarray
    y: np.ndarray

    def __len__(self) -> int:
        return len(self.y)

    def dense(self, width: int) -> np.ndarray:
        x = np.zeros((len(self), width))
        x[:, : self.num.shape[1]] = self.num
        rows, slots = np.nonzero(self.cat >= 0)
        x[rows, self.cat[rows, slots]] = 1.0
        return x


class ShardModel(ABC):
    @abstractmethod
    def initial(self, width: int) -> Params:
        """Parameters before the first round, for ``width`` features."""

    @abstractmethod
    def begin(self, params: Sequence[Params], alphas: Sequence[float]) -> Any:
        """State of a pass for each alpha from its own parameters, which stay unchanged."""

    @abstractmethod
    def step(self, state: Any, rows: Shard) -> None:
        """Trains every alpha on the next rows, in their order."""

    @abstractmethod
    def finish(self, state: Any) -> list[Params]:
        """Parameters of each alpha after the pass."""

    def train(self, shard: Shard, params: Params, alpha: float) -> Params:
        """Parameters after one pass over rows that are all at hand."""
        state = self.begin([params], [alpha])
        self.step(state, shard)
        return self.finish(state)[0]

    @abstractmethod
    def score(self, param: Callable[[str], str], spec: FeatureSpec) -> Column:
        """Probability of encoded rows; ``param(key)`` names the array column that holds
        a parameter's values in flat order."""

    def check(self, params: Params, width: int) -> None:
        """Rejects parameters with other keys or shapes than the model's own."""
        template = self.initial(width)
        if set(params) != set(template):
            raise KeyError(f"expected parameters {sorted(template)}, got {sorted(params)}")
        for key, value in template.items():
            if np.shape(params[key]) != value.shape:
                raise ValueError(
                    f"parameter {key} has shape {np.shape(params[key])}, expected {value.shape}"
                )


@dataclass
class _Pass:
    """One alpha's pass. Its weights are scale * weights, so shrinking them is one product.
    Plain floats: on rows of a few numbers most of a NumPy call is the call."""

    weights: list[float]
    bias: float
    scale: float
    shrink: float

    def learn(self, rows: Iterable[tuple], m: int, eta0: float, decay: float) -> None:
        """One step for each row (numbers, active indices, label)."""
        weights, bias, scale, shrink = self.weights, self.bias, self.scale, self.shrink
        for x, on, label in rows:
            z = math.sumprod(weights[:m], x)
            for j in on:
                z += weights[j]
            step = eta0 * (_sigmoid(bias + scale * z) - label)
            scale *= shrink
            if scale < 1e-9:
                weights[:] = [w * scale for w in weights]
                scale = 1.0
            change = step / scale
            weights[:m] = [w - change * v for w, v in zip(weights, x)]
            for j in on:
                weights[j] -= change
            bias -= step * decay
        self.bias, self.scale = bias, scale


def _sigmoid(z: float) -> float:
    e = math.exp(-min(abs(z), 700.0))
    return 1.0 / (1.0 + e) if z >= 0 else e / (1.0 + e)


@dataclass(frozen=True)
class LogisticSGD(ShardModel):
    """Logistic regression by plain SGD, one row per step, constant step size.

    L2 with strength alpha acts on the weights only. Sparse rows get a damped intercept
    step (``intercept_decay``), as is customary for sparse data.
    """

    eta0: float = LEARNING_RATE
    intercept_decay: float = INTERCEPT_DECAY

    def initial(self, width: int) -> Params:
        return {"coef": np.zeros((1, width)), "intercept": np.zeros(1)}

    def begin(self, params, alphas):
        width = params[0]["coef"].shape[-1]
        for p in params:
            self.check(p, width)
        return [
            _Pass(p["coef"][0].tolist(), float(p["intercept"][0]), 1.0, max(0.0, 1.0 - self.eta0 * alpha))
            for p, alpha in zip(params, alphas)
        ]

    def step(self, state, rows):
        if len(rows) and rows.cat.max(initial=-1) >= len(state[0].weights):
            raise ValueError("rows have more features than the model")
        active = [[j for j in on if j >= 0] for on in rows.cat.tolist()]
        plain = list(zip(rows.num.tolist(), active, rows.y.tolist()))
        for run in state:
            run.learn(plain, rows.num.shape[1], self.eta0, self.intercept_decay)

    def finish(self, state):
        return [
            {"coef": np.array([run.weights]) * run.scale, "intercept": np.array([run.bias])} for run in state
        ]

    def score(self, param, spec):
        bias = f"get({param('intercept')}, 0)"
        return probability(logit(param("coef"), bias, len(spec.num_cols), len(spec.cat_cols)))
