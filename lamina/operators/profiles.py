"""Profiles of fixed effects, their transforms, two-dimensional slices, and bootstraps of generalised and nonlinear models."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.functions.families import SPARK
from lamina.operators.glmm import GlmerResult, collapse, fit_rows
from lamina.operators.lmm import LmerResult, _normal_of
from lamina.operators.nlmm import NlmerResult, nlmer


def profile_fixed(model, names: list[str] | None = None, points: int = 20, spread: float = 4.0) -> DataFrame:
    """parameter, value, zeta of fixed effects at the fitted theta, over ``spread`` standard errors to either side. For a linear
    model zeta is the signed root of the rise of the ML deviance, which is known in closed form; for others it is Wald's."""
    linear = isinstance(model, LmerResult)
    rows, errors = [], dict(zip(model.fixef(), np.sqrt(np.diag(model.vcov())), strict=True))
    unscaled = dict(zip(model.fixef(), np.diag(model.solved.unscaled_vcov), strict=True)) if linear else {}
    for name in names or list(errors):
        at = model.fixef()[name]
        for v in np.linspace(at - spread * errors[name], at + spread * errors[name], points):
            rise = model.nobs() * math.log1p((v - at) ** 2 / (unscaled[name] * model.solved.pwrss)) if linear else ((v - at) / errors[name]) ** 2
            rows.append((name, float(v), float(math.copysign(math.sqrt(rise), v - at))))
    return model.source.sparkSession.createDataFrame(rows, "parameter string, value double, zeta double")


def transformed(profile: DataFrame, kind: str) -> DataFrame:
    """A profile with its values transformed: ``log``, ``variance`` (squared) or ``sd`` (root); values outside the domain go."""
    value = F.col("value")
    kinds = {"log": (F.log(value), value > 0), "variance": (value * value, value >= 0), "sd": (F.sqrt(value), value >= 0)}
    if kind not in kinds:
        raise ValueError(f"unknown transform {kind!r}; known: {', '.join(kinds)}")
    new, ok = kinds[kind]
    return profile.where(ok).withColumn("value", new)


def intervals(profile: DataFrame, level: float = 0.95) -> DataFrame:
    """parameter, estimate, lower, upper: where zeta crosses 0 and the normal quantiles, by linear interpolation; the ends of
    the profile where it doesn't."""
    z, found = tails.norm_ppf(0.5 + level / 2), {}
    for r in profile.orderBy("parameter", "value").collect():  # points of a few parameters
        found.setdefault(r["parameter"], []).append((r["zeta"], r["value"]))
    rows = [(str(k), *(float(np.interp(q, [a for a, _ in v], [b for _, b in v])) for q in (0.0, -z, z)), level) for k, v in found.items()]
    return profile.sparkSession.createDataFrame(rows, "parameter string, estimate double, lower double, upper double, level double")


def density(profile: DataFrame) -> DataFrame:
    """A profile with the density exp(-zeta^2 / 2), scaled to a largest value of 1 for each parameter."""
    raw = profile.withColumn("density", F.exp(-F.col("zeta") * F.col("zeta") / 2))
    top = raw.groupBy("parameter").agg(F.max("density").alias("__top"))
    return raw.join(F.broadcast(top), "parameter").withColumn("density", F.col("density") / F.col("__top")).drop("__top")


def slice_2d(model, first: str, second: str, points: int = 15, spread: float = 3.0) -> DataFrame:
    """value1, value2, zeta (unsigned) over a grid of two fixed effects at the fitted theta, others at their best there."""
    names = list(model.fixef())
    at = [names.index(first), names.index(second)]
    b, v = np.array(list(model.fixef().values()))[at], model.vcov()[np.ix_(at, at)]
    inverse, se = np.linalg.inv(v), np.sqrt(np.diag(v))
    rows = []
    for x in np.linspace(b[0] - spread * se[0], b[0] + spread * se[0], points):
        for y in np.linspace(b[1] - spread * se[1], b[1] + spread * se[1], points):
            gap = np.array([x, y]) - b
            rise = float(gap @ inverse @ gap)
            if isinstance(model, LmerResult):
                rise = model.nobs() * math.log1p(rise * model.solved.sigma2 / model.solved.pwrss)
            rows.append((float(x), float(y), math.sqrt(rise)))
    return model.source.sparkSession.createDataFrame(rows, "value1 double, value2 double, zeta double")


def bootstrap_glmer(model: GlmerResult, n: int = 100, seed: int = 0) -> np.ndarray:
    """n rows of fixed effects and theta, refitted to simulated responses; a failed fit is a row of nan. A replicate is one
    aggregation of the simulated rows."""
    out = []
    for i in range(n):
        drawn = model.simulate(seed * 1_000_003 + i).withColumn("y", F.col("sim")).drop("sim")
        prep = replace(model.prep, data=drawn)
        try:
            f = fit_rows(model.formula, prep, collapse(prep), model.family, model.layout, model.points, model.source, model.options, model.theta)
            out.append([*f.state.beta, *f.theta])
        except (ValueError, np.linalg.LinAlgError):
            out.append([math.nan] * (model.prep.p + len(model.theta)))
    return np.array(out)


def bootstrap_nlmer(model: NlmerResult, n: int = 100, seed: int = 0) -> np.ndarray:
    """n rows of the curve's parameters, theta and sigma, refitted to simulated responses."""
    x, y, group = model.names
    low, out = model.layout.factors(model.theta)[0], []
    for i in range(n):
        s = seed * 1_000_003 + i
        parameters = {k: F.lit(float(v)) for k, v in model.fixef().items()}
        drawn = [_normal_of(F.col(group).cast("string"), s, j) for j in range(len(model.random))]
        for a, name in enumerate(model.random):
            parameters[name] = parameters[name] + model.sigma * sum((float(low[a, j]) * drawn[j] for j in range(a + 1)), F.lit(0.0))
        value = model.curve.value(SPARK, F.col(x).cast("double"), *parameters.values())
        rows = model.source.where(F.col(y).isNotNull()).withColumn(y, value + model.sigma * F.randn(s))
        try:
            f = nlmer(model.curve, rows, x, y, group, model.random, list(map(float, model.phi)))
            out.append([*f.phi, *f.theta, f.sigma])
        except (ValueError, np.linalg.LinAlgError):
            out.append([math.nan] * (len(model.phi) + len(model.theta) + 1))
    return np.array(out)
