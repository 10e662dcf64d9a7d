"""Logistic scores and losses as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.settings import LOGIT_LIMIT, PROBABILITY_FLOOR


def logit(coef: str, intercept: str, n_num: int, n_cat: int) -> Column:
    """intercept + num . coef + the coefficient of every active category, where ``coef``
    names an array column and ``intercept`` is SQL text.

    Unrolled over the configured columns instead of a higher-order function, so it
    stays inside generated code. An unknown category (null) adds nothing; a known one
    must have a coefficient.
    """
    terms = [intercept]
    terms += [f"get(num, {i}) * get({coef}, {i})" for i in range(n_num)]
    terms += [
        f"if(get(cat, {j}) IS NULL, 0D, element_at({coef}, get(cat, {j}) + 1))" for j in range(n_cat)
    ]
    return F.expr(" + ".join(terms))


def literal_vector(values: Sequence[float]) -> Column:
    """A constant array; one expression text is parsed instead of a call per element."""
    numbers = (float(v) for v in values)
    return F.expr(
        "array("
        + ", ".join(f"{v!r}D" if math.isfinite(v) else f"double('{v}')" for v in numbers)
        + ")"
    )


def probability(z: Column) -> Column:
    """Sigmoid that never reaches 0 or 1, so thresholds stay distinguishable."""
    bounded = F.greatest(F.lit(-LOGIT_LIMIT), F.least(F.lit(LOGIT_LIMIT), z))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))
    return clipped(p)


def clipped(p: Column) -> Column:
    low, high = F.lit(PROBABILITY_FLOOR), F.lit(1.0 - PROBABILITY_FLOOR)
    return F.greatest(low, F.least(high, p))


def log_loss(y: Column, p: Column) -> Column:
    """Cross-entropy of one row with label 0 or 1."""
    q = clipped(p)
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q))


def class_weight(n: Column, pos: Column, positive: bool) -> Column:
    """Balanced weight n / (2 * class size); 1 when a class is missing."""
    neg = n - pos
    size = pos if positive else neg
    return F.when((pos > 0) & (neg > 0), n / (F.lit(2.0) * size)).otherwise(F.lit(1.0))
