"""Arguments of the training and evaluation plans, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults that decide results and therefore must not drift.
DEFAULT_SEED = 42
DEFAULT_FRACTIONS = (0.7, 0.15, 0.15)
DEFAULT_CATEGORICAL = ("state",)
DEFAULT_NUMERIC = (
    "initial_deposit",
    "out_sum",
    "in_sum",
    "net_flow",
    "in_max_daily_sum",
    "out_max_daily_sum",
)
SCHEMA_VERSION = "v1"
LEARNING_RATE = 0.01
INTERCEPT_DECAY = 0.01
LOGIT_LIMIT = 30.0
PROBABILITY_FLOOR = 1e-6
MASK_SCALE = 1000.0
SECRET_VARIABLE = "FL_SECURE_AGG_KEY"


@dataclass(frozen=True)
class FeatureSpec:
    """Which account columns feed the model."""

    cat_cols: tuple[str, ...] = DEFAULT_CATEGORICAL
    num_cols: tuple[str, ...] = DEFAULT_NUMERIC
    version: str = SCHEMA_VERSION


@dataclass(frozen=True)
class SplitSpec:
    train: float = DEFAULT_FRACTIONS[0]
    val: float = DEFAULT_FRACTIONS[1]
    test: float = DEFAULT_FRACTIONS[2]
    seed: int = DEFAULT_SEED

    def __post_init__(self) -> None:
        parts = (self.train, self.val, self.test)
        if abs(sum(parts) - 1.0) > 1e-6:
            raise ValueError("split fractions must add up to 1")
        if min(parts) <= 0:
            raise ValueError("every split fraction must be positive")


@dataclass(frozen=True)
class TrainSpec:
    """Settings shared by federated training and the per-bank baseline.

    Every bank is trained in ``shards`` parts whose results are averaged by row count;
    their number is a setting and does not depend on the rows.
    """

    alpha_grid: tuple[float, ...] = (1e-5,)
    rounds: int = 30
    local_epochs: int = 1
    patience: int = 3
    eta0: float = LEARNING_RATE
    intercept_decay: float = INTERCEPT_DECAY
    seed: int = DEFAULT_SEED
    shards: int = 4
    mask_scale: float = MASK_SCALE
    splits: tuple[str, ...] = field(default=("train",))

    def __post_init__(self) -> None:
        if not self.alpha_grid:
            raise ValueError("alpha_grid is empty")
        if self.rounds < 1 or self.local_epochs < 1 or self.patience < 1:
            raise ValueError("rounds, local_epochs and patience start at 1")
        if self.shards < 1:
            raise ValueError("shards must be positive")
        if not set(self.splits) <= {"train", "val"}:
            raise ValueError("training may use the train and val splits only")
