"""Parameter vectors used by queries that score without training first, so that the
same scores can be computed in SQL."""

from __future__ import annotations

# Weights of the six numeric features and intercepts.
NUMERIC_WEIGHTS = (0.8, 0.1, -0.2, 0.15, 0.05, -0.1)
SHARED_INTERCEPT = -0.5
LOCAL_SCALE = 0.5
LOCAL_INTERCEPT = {"bank_l": -0.2, "bank_m": -0.1, "bank_s": 0.0}
# Length of the vectors in SQL, which are made before the plan's width is known; positions
# beyond the width are never looked up there.
SQL_WIDTH = 256
PATH_ALPHAS = (0.2, 0.5)
PATH_ROUNDS = 8


def _category_weight(position: int) -> float:
    return ((position * 7) % 11 - 5) / 10


def shared_coef(width: int) -> list[float]:
    """One weight for each feature of a plan: the numeric ones first, then categories."""
    categories = width - len(NUMERIC_WEIGHTS)
    return [*NUMERIC_WEIGHTS, *(_category_weight(i) for i in range(categories))]


def shared_params(width: int = SQL_WIDTH) -> dict[str, list[float]]:
    return {"coef": shared_coef(width), "intercept": [SHARED_INTERCEPT]}


def local_params(bank: str, width: int = SQL_WIDTH) -> dict[str, list[float]]:
    return {
        "coef": [w * LOCAL_SCALE for w in shared_coef(width)],
        "intercept": [LOCAL_INTERCEPT[bank]],
    }


def path_params(alpha: float, round_id: int, width: int) -> dict[str, list[float]]:
    """A path of models whose loss first falls, then rises with the round."""
    reach = alpha * round_id
    return {"coef": [w * reach for w in shared_coef(width)], "intercept": [-0.1 * reach]}


def path_models(width: int = SQL_WIDTH) -> list[tuple[float, int, dict[str, list[float]]]]:
    return [
        (alpha, r, path_params(alpha, r, width))
        for alpha in PATH_ALPHAS
        for r in range(1, PATH_ROUNDS + 1)
    ]
