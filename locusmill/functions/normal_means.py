"""Empirical-Bayes normal means: x ~ N(theta, s^2) with theta from a prior whose weights and scales are estimated.

Five prior families. Each gives, for observations of one standard error, the posterior's first and second moment, the log
likelihood, and sums from which the prior is renewed so that the likelihood never falls (an EM step in closed form).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Places where log Phi is taken exactly; between them a cubic with the right slopes, off by less than 1e-12.
_STEP, _LOW, _HIGH = 1 / 256, -37.0, 9.0
_AT = np.arange(_LOW, _HIGH + _STEP / 2, _STEP)
_LOG = np.array([math.log(0.5 * math.erfc(-z / math.sqrt(2))) if z < 0 else math.log1p(-0.5 * math.erfc(z / math.sqrt(2))) for z in _AT])
_SLOPE = np.exp(-0.5 * _AT**2 - 0.5 * math.log(2 * math.pi) - _LOG)
LEAST = 1e-12


def log_phi(z: np.ndarray) -> np.ndarray:
    """The logarithm of the standard normal's distribution function."""
    inside = np.clip(z, _LOW, _HIGH - _STEP)
    i = ((inside - _LOW) / _STEP).astype(np.int64)
    t = (inside - _AT[i]) / _STEP
    a, b, c, d = _LOG[i], _LOG[i + 1], _SLOPE[i] * _STEP, _SLOPE[i + 1] * _STEP
    out = (1 + 2 * t) * (1 - t) ** 2 * a + t * (1 - t) ** 2 * c + t * t * (3 - 2 * t) * b + t * t * (t - 1) * d
    low = np.minimum(z, _LOW)
    far = -0.5 * low * low - np.log(-low) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / low**2 + 3 / low**4 - 15 / low**6)
    return np.where(z < _LOW, far, np.where(z >= _HIGH - _STEP, 0.0, out))


def log_normal(x: np.ndarray, var) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var) + x * x / var)


def above_zero(mean: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second moment of N(mean, s^2) given that it is above 0."""
    z = mean / s
    ratio = np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - log_phi(z))
    # far below 0 the difference mean + s * ratio cancels: its series instead
    far = z < -30
    zz = np.where(far, z, -31.0)
    first = np.where(far, s * (-1 / zz + 2 / zz**3 - 10 / zz**5), np.maximum(mean + s * ratio, LEAST * s))
    second = np.where(far, s * s * (2 / zz**2 - 10 / zz**4), np.maximum(s * s + mean * first, first * first))
    return first, second


@dataclass(frozen=True)
class Posterior:
    mean: np.ndarray
    second: np.ndarray
    loglik: np.ndarray
    sums: np.ndarray  # of what renews the prior


def _mixed(parts: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]], kept: int) -> Posterior:
    """Of components (weight, log likelihood, first, second moment); sums: weights of the components from ``kept`` on, and their moments."""
    logs = np.stack([np.log(max(w, LEAST)) + p for w, p, _, _ in parts])
    top = logs.max(axis=0)
    share = np.exp(logs - top)
    total = share.sum(axis=0)
    share /= total
    mean, second = ((share * np.stack([p[i] for p in parts])).sum(axis=0) for i in (2, 3))
    own = share[kept:]
    sums = np.concatenate([own.sum(axis=1), (own * np.stack([p[2] for p in parts[kept:]])).sum(axis=1), (own * np.stack([p[3] for p in parts[kept:]])).sum(axis=1)])
    return Posterior(mean, second, top + np.log(total), sums)


class Normal:
    """N(0, v)."""

    positive = False

    def start(self, square: float) -> np.ndarray:
        return np.array([square])

    def posterior(self, x: np.ndarray, s: float, prior: np.ndarray) -> Posterior:
        v = max(float(prior[0]), LEAST)
        shrunk = v / (v + s * s)
        mean = shrunk * x
        second = mean * mean + shrunk * s * s
        return Posterior(mean, second, log_normal(x, v + s * s), np.array([second.sum()]))

    def renewed(self, sums: np.ndarray, n: float, prior: np.ndarray) -> np.ndarray:
        return np.array([max(sums[0] / n, LEAST)])


class PointNormal(Normal):
    """0 with weight 1 - w, else N(0, v)."""

    def start(self, square: float) -> np.ndarray:
        return np.array([0.5, 2 * square])

    def posterior(self, x: np.ndarray, s: float, prior: np.ndarray) -> Posterior:
        w, v = float(prior[0]), max(float(prior[1]), LEAST)
        shrunk = v / (v + s * s)
        zero = np.zeros_like(x)
        return _mixed([(1 - w, log_normal(x, s * s), zero, zero), (w, log_normal(x, v + s * s), shrunk * x, (shrunk * x) ** 2 + shrunk * s * s)], 1)

    def renewed(self, sums: np.ndarray, n: float, prior: np.ndarray) -> np.ndarray:
        return np.array([np.clip(sums[0] / n, LEAST, 1 - LEAST), max(sums[2] / max(sums[0], LEAST), LEAST)])


class PointExponential:
    """0 with weight 1 - w, else exponential with rate a: never below 0."""

    positive = True

    def start(self, square: float) -> np.ndarray:
        return np.array([0.5, 1 / math.sqrt(square)])

    def posterior(self, x: np.ndarray, s: float, prior: np.ndarray) -> Posterior:
        w, a = float(prior[0]), float(prior[1])
        zero, mean = np.zeros_like(x), x - a * s * s
        return _mixed([(1 - w, log_normal(x, s * s), zero, zero), (w, math.log(a) - a * x + a * a * s * s / 2 + log_phi(mean / s), *above_zero(mean, s))], 1)

    def renewed(self, sums: np.ndarray, n: float, prior: np.ndarray) -> np.ndarray:
        return np.array([np.clip(sums[0] / n, LEAST, 1 - LEAST), np.clip(sums[0] / max(sums[1], LEAST), LEAST, 1 / LEAST)])


class PointLaplace:
    """0 with weight 1 - w, else two-sided exponential with rate a."""

    positive = False

    def start(self, square: float) -> np.ndarray:
        return np.array([0.5, 1 / math.sqrt(square)])

    def posterior(self, x: np.ndarray, s: float, prior: np.ndarray) -> Posterior:
        w, a = float(prior[0]), float(prior[1])
        sides = []
        for sign in (1.0, -1.0):
            mean = sign * x - a * s * s
            first, second = above_zero(mean, s)
            sides.append((w / 2, math.log(a) - a * sign * x + a * a * s * s / 2 + log_phi(mean / s), sign * first, second))
        zero = np.zeros_like(x)
        return _mixed([(1 - w, log_normal(x, s * s), zero, zero), *sides], 1)

    def renewed(self, sums: np.ndarray, n: float, prior: np.ndarray) -> np.ndarray:
        weight = sums[0] + sums[1]
        return np.array([np.clip(weight / n, LEAST, 1 - LEAST), np.clip(weight / max(sums[2] - sums[3], LEAST), LEAST, 1 / LEAST)])


class NormalScaleMixture:
    """A mixture of 0 and normals of fixed scales, SCALES of them, each twice as wide as the one before."""

    positive = False
    SCALES = 10

    def start(self, square: float) -> np.ndarray:
        return np.array([4 * math.sqrt(square), *[1 / (self.SCALES + 1)] * (self.SCALES + 1)])

    def posterior(self, x: np.ndarray, s: float, prior: np.ndarray) -> Posterior:
        zero = np.zeros_like(x)
        parts = [(float(prior[1]), log_normal(x, s * s), zero, zero)]
        for i, w in enumerate(prior[2:]):
            v = (float(prior[0]) / 2 ** (self.SCALES - 1 - i)) ** 2
            shrunk = v / (v + s * s)
            parts.append((float(w), log_normal(x, v + s * s), shrunk * x, (shrunk * x) ** 2 + shrunk * s * s))
        return _mixed(parts, 0)

    def renewed(self, sums: np.ndarray, n: float, prior: np.ndarray) -> np.ndarray:
        w = np.maximum(sums[: self.SCALES + 1], LEAST)
        return np.array([prior[0], *(w / w.sum())])


#: The prior families by name.
FAMILIES = {"normal": Normal(), "point_normal": PointNormal(), "point_exponential": PointExponential(), "point_laplace": PointLaplace(), "normal_scale_mixture": NormalScaleMixture()}


def relative_entropy(post: Posterior, x: np.ndarray, s: float) -> float:
    """Sum of E log prior(theta) / posterior(theta) under the posterior, which is never above 0."""
    return float((post.loglik + 0.5 * np.log(2 * np.pi * s * s) + (x * x - 2 * x * post.mean + post.second) / (2 * s * s)).sum())


def estimated(family: str, x: np.ndarray, s: float, prior: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, Posterior]:
    """The prior that EM finds from ``prior`` on for observations that are all at hand, and its posterior."""
    own, last = FAMILIES[family], -np.inf
    for _ in range(rounds):
        post = own.posterior(x, s, prior)
        now = float(post.loglik.sum())
        if now - last < 1e-8 * abs(now):
            break
        last = now
        prior = own.renewed(post.sums, len(x), prior)
    return prior, own.posterior(x, s, prior)
