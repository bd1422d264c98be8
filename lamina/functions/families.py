"""Link functions and response families, each as Catalyst columns and as numpy, from one description.

Every formula is written once over a small set of operations; ``SPARK`` and ``NUMPY`` supply these operations. So rows
are transformed inside the engine, and the driver's iterations use the same expressions on arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from lamina.functions.tails import norm_cdf, norm_ppf

TINY = 1e-10


def _normal_cdf_column(x):
    """Normal distribution function as a column: the complementary error function by a rational Chebyshev fit with a
    relative error of about 1e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    # fixed values: coefficients of the fit, lowest order first
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        power = power * t + c
    upper = t * F.exp(-z * z + power) / 2
    return F.when(x >= 0, 1 - upper).otherwise(upper)


SPARK = SimpleNamespace(
    exp=F.exp, log=F.log, sqrt=F.sqrt, tan=F.tan, atan=F.atan, cos=F.cos, abs=F.abs, cdf=_normal_cdf_column,
    where=lambda c, a, b: F.when(c, a).otherwise(b), greatest=lambda a, b: F.greatest(a, F.lit(float(b))), least=lambda a, b: F.least(a, F.lit(float(b))), one=lambda x: F.lit(1.0),
)
NUMPY = SimpleNamespace(
    exp=np.exp, log=np.log, sqrt=np.sqrt, tan=np.tan, atan=np.arctan, cos=np.cos, abs=np.abs, cdf=np.vectorize(norm_cdf, otypes=[float]),
    where=np.where, greatest=np.maximum, least=np.minimum, one=np.ones_like,
)


def xlogy(ops: Any, x: Any, y: Any) -> Any:
    """x log y, and 0 where x is 0."""
    return ops.where(x == 0, 0.0 * y, x * ops.log(ops.where(x == 0, ops.one(y), y)))


@dataclass(frozen=True)
class Link:
    """eta = g(mu), its inverse, and g'(mu); ``low`` and ``high`` bound the means it allows."""

    name: str
    low: float = -math.inf
    high: float = math.inf

    def link(self, mu: Any, ops: Any = NUMPY) -> Any:
        match self.name:
            case "identity":
                return mu
            case "log":
                return ops.log(mu)
            case "logit":
                return ops.log(mu / (1 - mu))
            case "probit":
                if ops is SPARK:
                    raise NotImplementedError("the probit link of a mean has no column form; its inverse has")
                return np.vectorize(norm_ppf, otypes=[float])(mu)
            case "cloglog":
                return ops.log(-ops.log(1 - mu))
            case "cauchit":
                return ops.tan(math.pi * (mu - 0.5))
            case "inverse":
                return 1 / mu
            case "sqrt":
                return ops.sqrt(mu)
        return 1 / (mu * mu)

    def inverse(self, eta: Any, ops: Any = NUMPY) -> Any:
        match self.name:
            case "identity":
                return eta
            case "log":
                return ops.exp(ops.least(eta, 700))
            case "logit":
                return 1 / (1 + ops.exp(-ops.greatest(ops.least(eta, 700), -700)))
            case "probit":
                return ops.cdf(eta)
            case "cloglog":
                return 1 - ops.exp(-ops.exp(ops.least(eta, 700)))
            case "cauchit":
                return ops.atan(eta) / math.pi + 0.5
            case "inverse":
                return 1 / ops.greatest(eta, TINY)
            case "sqrt":
                return eta * eta
        return 1 / ops.sqrt(ops.greatest(eta, TINY))

    def slope(self, mu: Any, ops: Any = NUMPY) -> Any:
        """The derivative of the link at mu."""
        match self.name:
            case "identity":
                return 0 * mu + 1
            case "log":
                return 1 / mu
            case "logit":
                return 1 / (mu * (1 - mu))
            case "probit":
                eta = self.link(mu, ops)
                return math.sqrt(2 * math.pi) * ops.exp(eta * eta / 2)
            case "cloglog":
                return 1 / ((1 - mu) * -ops.log(1 - mu))
            case "cauchit":
                c = ops.cos(math.pi * (mu - 0.5))
                return math.pi / (c * c)
            case "inverse":
                return -1 / (mu * mu)
            case "sqrt":
                return 0.5 / ops.sqrt(mu)
        return -2 / (mu * mu * mu)


_INF = math.inf
LINKS = {k.name: k for k in (Link("identity"), Link("log", 0), Link("logit", 0, 1), Link("probit", 0, 1), Link("cloglog", 0, 1), Link("cauchit", 0, 1), Link("inverse", 0), Link("sqrt", 0), Link("inverse_squared", 0))}


def resolve_link(link: str | Link) -> Link:
    if isinstance(link, Link):
        return link
    if link not in LINKS:
        raise ValueError(f"unknown link {link!r}; known: {', '.join(LINKS)}")
    return LINKS[link]


@dataclass(frozen=True)
class Family:
    """A response family: variance and unit deviance as functions of the mean, with its link."""

    name: str
    link: Link
    low: float = -_INF
    high: float = _INF
    theta: float = 1.0  # of the negative binomial
    phi: float = 1.0  # of a quasi family

    def variance(self, mu: Any, ops: Any = NUMPY) -> Any:
        match self.name:
            case "gaussian":
                v = 0 * mu + 1
            case "binomial":
                v = mu * (1 - mu)
            case "poisson":
                v = mu
            case "gamma":
                v = mu * mu
            case "inverse_gaussian":
                v = mu * mu * mu
            case _:
                v = mu + mu * mu / self.theta
        return self.phi * v

    def deviance(self, y: Any, mu: Any, w: Any, ops: Any = NUMPY) -> Any:
        """The weighted unit deviance of each row."""
        match self.name:
            case "gaussian":
                d = (y - mu) * (y - mu)
            case "binomial":
                d = 2 * (xlogy(ops, y, y / mu) + xlogy(ops, 1 - y, (1 - y) / (1 - mu)))
            case "poisson":
                d = 2 * (xlogy(ops, y, y / mu) - (y - mu))
            case "gamma":
                ratio = ops.greatest(y, TINY) / mu
                d = 2 * (ratio - 1 - ops.log(ratio))
            case "inverse_gaussian":
                d = (y - mu) * (y - mu) / (mu * mu * y)
            case _:
                d = 2 * (xlogy(ops, y, y / mu) - (y + self.theta) * ops.log((y + self.theta) / (mu + self.theta)))
        return w * d / self.phi

    def weight(self, mu: Any, ops: Any = NUMPY) -> Any:
        """The working weight 1 / (g'(mu)^2 V(mu))."""
        g = self.link.slope(mu, ops)
        return 1 / (g * g * self.variance(mu, ops))

    def clamp(self, mu: Any, ops: Any = NUMPY, eps: float = TINY) -> Any:
        low, high = max(self.low, self.link.low), min(self.high, self.link.high)
        mu = ops.greatest(mu, low + eps) if math.isfinite(low) else mu
        return ops.least(mu, high - eps) if math.isfinite(high) else mu

    def start(self, y: Any, ops: Any = NUMPY) -> Any:
        """Means to begin iterations from."""
        low, high = max(self.low, self.link.low), min(self.high, self.link.high)
        if low == 0 and high == 1:
            return (y + 0.5) / 2
        return ops.greatest(y, 0.1) if low == 0 else y

    def mean(self, eta: Any, ops: Any = NUMPY) -> Any:
        return self.clamp(self.link.inverse(eta, ops), ops)

    def simulate(self, mu: np.ndarray, rng: np.random.Generator, sigma: float = 1.0) -> np.ndarray:
        match self.name:
            case "gaussian":
                return rng.normal(mu, sigma)
            case "binomial":
                return rng.binomial(1, mu).astype(float)
            case "poisson":
                return rng.poisson(mu).astype(float)
            case "gamma":
                return rng.gamma(1.0, mu)
            case "inverse_gaussian":
                return rng.wald(mu, 1.0)
        return rng.negative_binomial(self.theta, self.theta / (self.theta + mu)).astype(float)

    def quasi(self, phi: float) -> Family:
        return Family(f"{self.name}", self.link, self.low, self.high, self.theta, phi)


_DEFAULT = {"gaussian": ("identity", -_INF, _INF), "binomial": ("logit", 0, 1), "poisson": ("log", 0, _INF), "gamma": ("log", 0, _INF), "inverse_gaussian": ("log", 0, _INF), "negative_binomial": ("log", 0, _INF)}


def family(name: str, link: str | Link | None = None, theta: float = 1.0) -> Family:
    """A family by name, with its usual link unless another is given."""
    if name not in _DEFAULT:
        raise ValueError(f"unknown family {name!r}; known: {', '.join(_DEFAULT)}")
    usual, low, high = _DEFAULT[name]
    return Family(name, resolve_link(link or usual), low, high, theta)
