"""Column functions of candidates' scores; some are aggregates over a candidate's fired rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_conf() -> Column:
    return F.max("conf")


def linear(bias: float = 0.0) -> Column:
    """The sum of the weights of all fired rules, repeated ids repeated, plus a bias."""
    return F.sum("weight") + F.lit(bias)


def surprisal(conf: Column) -> Column:
    """``-log(1 - conf)`` with the confidence kept below 1."""
    return -F.log1p(-F.least(conf, F.lit(1 - 1e-7)))


def noisy_or(weight: str = "weight", extra: Column | None = None) -> Column:
    """``1 - exp(-sum)``, kept from 0 and 1."""
    total = F.sum(weight) if extra is None else F.sum(weight) + extra
    return F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), 1 - F.exp(-total)))


def sigmoid(x: Column) -> Column:
    """The prediction of the linear model from its score."""
    return 1 / (1 + F.exp(-x))


def surprisal_score(bias: float = 0.0, gamma: float = 1.0, weight: str = "weight", pairs: Column | None = None) -> Column:
    """The noisy-or of the fired rules' weights, ``gamma`` times the summed weights of their pairs, and the squared bias."""
    extra = F.lit(bias * bias) if pairs is None else F.lit(gamma) * pairs + F.lit(bias * bias)
    return noisy_or(weight, extra)


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(x))
