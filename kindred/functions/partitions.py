"""Clustering priors of the Ewens-Pitman family, as sequential seating weights.

``existing(n)`` and ``new(k)`` work on columns and on numbers alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.distributions import Beta, Gamma, ShiftedNegBinom


def _abs(x):
    return F.abs(x) if isinstance(x, Column) else abs(x)


def _value(x):
    return x if isinstance(x, (int, float)) else x.mean()


@dataclass(frozen=True)
class PitmanYor:
    alpha: float | Gamma
    d: float | Beta = 0.0

    def __post_init__(self):
        if not isinstance(self.d, Beta) and not 0 <= self.d < 1:
            raise ValueError("d must be in [0, 1)")
        least = 0 if isinstance(self.d, Beta) else -self.d
        if not isinstance(self.alpha, Gamma) and not (math.isfinite(self.alpha) and self.alpha > least):
            raise ValueError("alpha must be finite and greater than -d")

    def initial(self, n: int) -> PitmanYor:
        return PitmanYor(_value(self.alpha), _value(self.d))

    def drawn(self, rng) -> PitmanYor:
        pick = lambda v: v if isinstance(v, (int, float)) else float(v.draw(rng)[0])
        return PitmanYor(pick(self.alpha), pick(self.d))

    def random(self) -> dict[str, str]:
        return {k: k for k in ("alpha", "d") if not isinstance(getattr(self, k), (int, float))}

    def existing(self, n):
        return _abs(n - self.d)

    def new(self, k):
        return self.alpha + self.d * k


def Ewens(alpha: float | Gamma) -> PitmanYor:  # noqa: N802
    return PitmanYor(alpha, 0.0)


@dataclass(frozen=True)
class GeneralizedCoupon:
    """m entities; kappa infinite is the uniform allocation."""

    m: int | ShiftedNegBinom
    kappa: float | Gamma

    def __post_init__(self):
        if not isinstance(self.m, ShiftedNegBinom) and not (self.m >= 1 and self.m == int(self.m)):
            raise ValueError("m must be a positive integer")
        if not isinstance(self.kappa, Gamma) and not self.kappa > 0:
            raise ValueError("kappa must be positive")
        if not isinstance(self.kappa, Gamma) and math.isinf(self.kappa) and isinstance(self.m, ShiftedNegBinom):
            raise ValueError("an infinite kappa needs a fixed m")

    def initial(self, n: int) -> GeneralizedCoupon:
        if isinstance(self.m, int) and self.m < n:
            raise ValueError("m must not be smaller than the number of records")
        m = _value(self.m)
        return GeneralizedCoupon(max(n, round(m)) if math.isfinite(m) else n, _value(self.kappa))

    def drawn(self, rng) -> GeneralizedCoupon:
        pick = lambda v: v if isinstance(v, (int, float)) else v.draw(rng)[0]
        return GeneralizedCoupon(int(pick(self.m)), float(pick(self.kappa)))

    def random(self) -> dict[str, str]:
        return {k: k for k in ("kappa", "m") if not isinstance(getattr(self, k), (int, float))}

    def existing(self, n):
        return n * 0.0 + 1.0 if math.isinf(self.kappa) else n + self.kappa

    def new(self, k):
        return _abs(self.m - k) if math.isinf(self.kappa) else self.kappa * _abs(self.m - k)


def seat(n: int, prior, rng: np.random.Generator) -> np.ndarray:
    """One partition of n items, as labels, by sequential seating."""
    labels, sizes = np.zeros(n, np.int64), []
    for i in range(n):
        w = [float(prior.existing(s)) for s in sizes] + [max(0.0, float(prior.new(len(sizes))))]
        if i == 0:
            w = [1.0]
        c = np.cumsum(w)
        k = int(np.searchsorted(c, rng.random() * c[-1], "right"))
        if k == len(sizes):
            sizes.append(0)
        sizes[k] += 1
        labels[i] = k
    return labels


def sample_ewens_pitman(n: int, alpha: float, sigma: float, seed: int = 1) -> list[list[int]]:
    """Blocks of one partition. sigma in [0, 1) with alpha > -sigma, or sigma < 0 with
    alpha a positive multiple of -sigma."""
    if sigma >= 1 or (0 <= sigma and alpha <= -sigma):
        raise ValueError("sigma must be below 1, and alpha greater than -sigma")
    if sigma < 0 and not (alpha > 0 and math.isclose(alpha / -sigma, round(alpha / -sigma))):
        raise ValueError("for a negative sigma alpha must be a positive multiple of -sigma")
    prior = PitmanYor(alpha, sigma) if sigma >= 0 else GeneralizedCoupon(round(alpha / -sigma), -sigma)
    labels = seat(n, prior, np.random.default_rng(seed))
    return [np.flatnonzero(labels == k).tolist() for k in range(labels.max() + 1)]


def sample_partitions(spark: SparkSession, n: int, prior, replicates: int, seed: int = 1) -> DataFrame:
    """replicate, item, label: independent partitions, hyperparameters drawn anew for each.
    Replicates are spread over tasks; each is seeded by its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, k]))
                yield pd.DataFrame({"replicate": k, "item": np.arange(n), "label": seat(n, prior.drawn(rng), rng)})

    return spark.range(replicates).mapInPandas(run, "replicate bigint, item bigint, label bigint")
