"""Random variables: moments, densities as columns, and seeded draws.

``density(x)`` takes a column and gives a column; the log-gamma function, which Spark
lacks, is one vectorised UDF. ``draw(rng, n)`` takes a numpy Generator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not (math.isfinite(v) and v > 0):
            raise ValueError(f"{name} must be positive and finite")


def lgamma(x: Column) -> Column:
    @F.pandas_udf("double")
    def lg(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(math.lgamma, na_action="ignore")

    return lg(x.cast("double"))


class _Scalar:
    def sd(self) -> float:
        return math.sqrt(self.var())


@dataclass(frozen=True)
class Beta(_Scalar):
    a: float
    b: float

    def __post_init__(self):
        _positive(a=self.a, b=self.b)

    def mean(self) -> float:
        return self.a / (self.a + self.b)

    def var(self) -> float:
        s = self.a + self.b
        return self.a * self.b / (s * s * (s + 1))

    def log_density(self, x: Column) -> Column:
        c = math.lgamma(self.a + self.b) - math.lgamma(self.a) - math.lgamma(self.b)
        return F.when((x > 0) & (x < 1), F.lit(c) + (self.a - 1) * F.ln(x) + (self.b - 1) * F.ln(1 - x))

    def density(self, x: Column) -> Column:
        return F.coalesce(F.exp(self.log_density(x)), F.lit(0.0))

    def draw(self, rng, n: int = 1):
        return rng.beta(self.a, self.b, n)


@dataclass(frozen=True)
class Gamma(_Scalar):
    shape: float
    rate: float

    def __post_init__(self):
        _positive(shape=self.shape, rate=self.rate)

    def mean(self) -> float:
        return self.shape / self.rate

    def var(self) -> float:
        return self.shape / self.rate**2

    def log_density(self, x: Column) -> Column:
        c = self.shape * math.log(self.rate) - math.lgamma(self.shape)
        return F.when(x > 0, F.lit(c) + (self.shape - 1) * F.ln(x) - self.rate * x)

    def density(self, x: Column) -> Column:
        return F.coalesce(F.exp(self.log_density(x)), F.lit(0.0))

    def draw(self, rng, n: int = 1):
        return rng.gamma(self.shape, 1 / self.rate, n)


@dataclass(frozen=True)
class ShiftedNegBinom(_Scalar):
    """1 + a negative binomial count of failures before ``size`` successes."""

    size: float
    prob: float

    def __post_init__(self):
        _positive(size=self.size, prob=self.prob)
        if self.prob >= 1:
            raise ValueError("prob must be below 1")

    def mean(self) -> float:
        return self.size * (1 - self.prob) / self.prob + 1

    def var(self) -> float:
        return self.size * (1 - self.prob) / self.prob**2

    def log_density(self, x: Column) -> Column:
        k = x - 1
        c = self.size * math.log(self.prob) - math.lgamma(self.size)
        return F.when((x >= 1) & (x == F.floor(x)), lgamma(k + self.size) - lgamma(k + 1.0) + c + k * math.log(1 - self.prob))

    def density(self, x: Column) -> Column:
        return F.coalesce(F.exp(self.log_density(x)), F.lit(0.0))

    def draw(self, rng, n: int = 1):
        return 1 + rng.negative_binomial(self.size, self.prob, n)


@dataclass(frozen=True)
class Dirichlet:
    """A scalar alpha is symmetric over a domain whose size the model knows."""

    alpha: float | tuple[float, ...] | dict[str, float]

    def __post_init__(self):
        _positive(**{f"alpha{k}": v for k, v in enumerate(self.values())})

    def values(self) -> list[float]:
        a = self.alpha
        return list(a.values()) if isinstance(a, dict) else list(a) if isinstance(a, tuple) else [a]

    def _vector(self) -> np.ndarray:
        if not isinstance(self.alpha, (tuple, dict)):
            raise ValueError("a scalar alpha has no size of its own")
        return np.array(self.values(), float)

    def mean(self) -> np.ndarray:
        a = self._vector()
        return a / a.sum()

    def var(self) -> np.ndarray:
        m = self.mean()
        return (np.diag(m) - np.outer(m, m)) / (self._vector().sum() + 1)

    def draw(self, rng, n: int = 1):
        return rng.dirichlet(self._vector(), n)


@dataclass(frozen=True)
class DirichletProcess:
    """Concentration of the distribution of distorted values about its base; infinity
    is the base itself. May be Gamma-distributed."""

    alpha: float | Gamma = math.inf

    def __post_init__(self):
        if not isinstance(self.alpha, Gamma) and not self.alpha > 0:
            raise ValueError("alpha must be positive")

    def initial(self) -> float:
        return self.alpha.mean() if isinstance(self.alpha, Gamma) else self.alpha
