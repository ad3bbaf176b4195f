"""The frequency grid and the folded, zero-inflated beta prior over it.

Windows run from 0 to 0.5 and get wider by a constant factor; the first grid point is 0 (no
polymorphism), the others are window midpoints. A window's probability is the beta mass of the
window and of its mirror image above 0.5, times the probability of being polymorphic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def boundaries(points: int, concentration: float = 10.0) -> np.ndarray:
    """The `points` window boundaries, 0 first and 0.5 last."""
    i = np.arange(points) / (points - 1)
    return np.expm1(i * math.log1p(concentration * 0.5)) / concentration


def frequencies(points: int, concentration: float = 10.0) -> np.ndarray:
    v = boundaries(points, concentration)
    return np.concatenate([[0.0], (v[:-1] + v[1:]) / 2])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, terms: int = 300) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, terms):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    return h


def betainc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), in float64."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    a, b, x = a[inside], b[inside], x[inside]
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)) if x.size else x
    low = x < (a + 1) / (a + b + 2)
    got = np.empty_like(x)
    got[low] = front[low] * _fraction(a[low], b[low], x[low]) / a[low]
    high = ~low
    got[high] = 1 - front[high] * _fraction(b[high], a[high], 1 - x[high]) / b[high]
    out[inside] = got
    return out


def _log_tails(a: float, b: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log I_x(a, b) and log(1 - I_x(a, b)): the smaller of the two is computed, so neither cancels or underflows."""
    with np.errstate(divide="ignore"):
        if a == 1 or b == 1:
            small = b * np.log1p(-x) if a == 1 else a * np.log(x)
            upper_is_small = np.full(x.shape, a == 1)
        else:
            front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x)
            upper_is_small = x >= (a + 1) / (a + b + 2)
            lower = _fraction(np.full(x.shape, a), np.full(x.shape, b), np.where(upper_is_small, 0.0, x)) / a
            upper = _fraction(np.full(x.shape, b), np.full(x.shape, a), np.where(upper_is_small, 1 - x, 0.0)) / b
            small = front + np.log(np.where(upper_is_small, upper, lower))
        rest = np.where(small > -math.log(2), np.log(-np.expm1(small)), np.log1p(-np.exp(small)))
    return np.where(upper_is_small, rest, small), np.where(upper_is_small, small, rest)


def _log_masses(a: float, b: float, v: np.ndarray) -> np.ndarray:
    """The log of the beta mass of each window between boundaries, from the tail in which it is the larger part."""
    lower, upper = _log_tails(a, b, v)
    above = upper[:-1] < lower[1:]
    big, small = np.where(above, upper[:-1], lower[1:]), np.where(above, upper[1:], lower[:-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(big), big, big + np.log(-np.expm1(small - big)))


@F.pandas_udf(DoubleType())
def betainc_column(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(betainc(a, b, x))


@dataclass(frozen=True)
class Prior:
    """a and b of the beta distribution; z, the probability that a site is not polymorphic."""

    a: float = 1.0
    b: float = 20.0
    z: float = 0.9

    @staticmethod
    def of(params: np.ndarray) -> Prior:
        """From (log a, log b, logit z)."""
        return Prior(math.exp(params[0]), math.exp(params[1]), 1 / (1 + math.exp(-params[2])))

    @property
    def params(self) -> np.ndarray:
        return np.array([math.log(self.a), math.log(self.b), math.log(self.z / (1 - self.z))])

    def log_probabilities(self, points: int, concentration: float = 10.0) -> np.ndarray:
        """The log-probability of each grid point; they sum to 1. A window has -inf only if its probability is below the least double."""
        v = boundaries(points, concentration)
        mass = np.logaddexp(_log_masses(self.a, self.b, v), _log_masses(self.b, self.a, v))  # of the window and of its mirror image
        with np.errstate(divide="ignore"):
            return np.log(np.concatenate([[self.z], (1 - self.z) * np.exp(mass)]))

    def gradient(self, points: int, concentration: float = 10.0, eps: float = 1e-5) -> np.ndarray:
        """d log_probabilities / d params, a row for each of the three, by central differences."""
        p = self.params
        steps = np.eye(3) * eps
        with np.errstate(invalid="ignore"):
            rows = [(Prior.of(p + s).log_probabilities(points, concentration) - Prior.of(p - s).log_probabilities(points, concentration)) / (2 * eps) for s in steps]
        return np.nan_to_num(np.stack(rows))


def grid(spark: SparkSession, points: int, prior: Prior | None = None, concentration: float = 10.0) -> DataFrame:
    """k, f, log_f, log_1mf and, with a prior, lpf of the grid: `points` rows, so it may be broadcast."""
    f = frequencies(points, concentration)
    with np.errstate(divide="ignore"):
        table = pd.DataFrame({"k": np.arange(points, dtype=np.int32), "f": f, "log_f": np.log(f), "log_1mf": np.log1p(-f)})
    if prior:
        table["lpf"] = prior.log_probabilities(points, concentration)
    return spark.createDataFrame(table)
