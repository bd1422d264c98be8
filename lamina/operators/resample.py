"""Parametric bootstrap, cross-validation and power by simulation.

A replicate differs from the fit only in the response, so the design's cross-products are reused: several simulated
responses are drawn as columns in one pass, and only their products with the design are summed.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.operators import grouped
from lamina.operators.gram import Gram, fixed_names, gram, random_names
from lamina.operators.lmm import LmerResult, _fit, _normal_of, lmer

PER_PASS = 10


def _simulated(model: LmerResult, seeds: list[int], shift: dict[str, float] | None = None):
    """A column of the fixed mean (coefficients replaced by ``shift``), new effects and new noise, for every seed."""
    beta = model.fixef() | (shift or {})
    base = F.col("o")
    for i, n in enumerate(model.prep.x_names):
        base = base + beta[n] * F.col(f"x{i}")
    out = []
    for seed in seeds:
        total = base
        for k, f in enumerate(model.layout.factors(model.theta)):
            drawn = [_normal_of(F.col(f"g{k}"), seed, 100 * k + i) for i in range(f.shape[0])]
            for i, z in enumerate(random_names(model.prep, k)):
                total = total + model.sigma * sum((float(f[i, j]) * drawn[j] for j in range(i + 1)), F.lit(0.0)) * F.col(z)
        out.append(total + model.sigma * F.randn(seed) / F.sqrt("w"))
    return out


def replicates(model: LmerResult, n: int, seed: int = 0, shift: dict[str, float] | None = None):
    """Yield the cross-products of n simulated responses."""
    x = fixed_names(model.prep)
    for begin in range(0, n, PER_PASS):
        seeds = [seed * 1_000_003 + i for i in range(begin, min(n, begin + PER_PASS))]
        data = model.prep.data.select("*", *[(c - F.col("o")).alias(f"s{j}") for j, c in enumerate(_simulated(model, seeds, shift))])
        sums = [F.array(*[F.sum(F.col("w") * F.col(a) * F.col(f"s{j}")) for a in [*x, f"s{j}"]]).alias(f"t{j}") for j in range(len(seeds))]
        parts: list[list[np.ndarray]] = [[] for _ in seeds]
        if not model.prep.random:
            row = data.agg(*sums).first()
            totals = [np.array(row[f"t{j}"]) for j in range(len(seeds))]
        else:
            for k in range(len(model.prep.random)):
                z = [F.array(*[F.sum(F.col("w") * F.col(a) * F.col(f"s{j}")) for a in random_names(model.prep, k)]).alias(f"z{j}_") for j in range(len(seeds))]
                rows = data.groupBy(F.col(f"g{k}").alias("key")).agg(*z, *(sums if k == 0 else [])).toPandas().set_index("key").loc[model.gram.keys[k]]
                for j in range(len(seeds)):
                    parts[j].append(np.array(rows[f"z{j}_"].to_list()))
                if k == 0:
                    totals = [np.array(rows[f"t{j}"].to_list()).sum(0) for j in range(len(seeds))]
        for j in range(len(seeds)):
            yield replace(model.gram, xy=totals[j][:-1], yy=float(totals[j][-1]), zy=parts[j])


def _refit(model: LmerResult, g: Gram) -> LmerResult:
    return _fit(model.formula, model.prep, g, model.layout, model.reml, model.theta if len(model.theta) and model.theta.max() > 0 else None, model.source, model.options)


def bootstrap(model: LmerResult, n: int = 100, seed: int = 0) -> np.ndarray:
    """n rows of fixed effects, theta and sigma, refitted to simulated responses."""
    fits = [_refit(model, g) for g in replicates(model, n, seed)]
    return np.array([[*f.solved.beta, *f.theta, f.sigma] for f in fits])


def boot_ci(model: LmerResult, samples: np.ndarray, level: float = 0.95, method: str = "percentile") -> DataFrame:
    """Intervals of the fixed effects: percentile, basic or normal."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    rows = []
    for i, (name, b) in enumerate(model.fixef().items()):
        s = samples[:, i][np.isfinite(samples[:, i])]
        q = np.quantile(s, [lo, hi])
        z, bias = tails.norm_ppf(hi), s.mean() - b
        low, high = {"percentile": (q[0], q[1]), "basic": (2 * b - q[1], 2 * b - q[0]), "normal": (b - bias - z * s.std(ddof=1), b - bias + z * s.std(ddof=1))}[method]
        rows.append((name, method, b, float(s.mean()), float(bias), float(s.std(ddof=1)), float(low), float(high), len(s)))
    return model.source.sparkSession.createDataFrame(rows, "parameter string, method string, estimate double, mean double, bias double, std_error double, conf_low double, conf_high double, n_success int")


def power(model: LmerResult, term: str, effect: float | None = None, n: int = 100, alpha: float = 0.05, seed: int = 0) -> dict[str, float]:
    """The share of simulations in which the Wald test of ``term`` rejects, with a score interval."""
    at = model.prep.x_names.index(term)
    hits = 0
    for g in replicates(model, n, seed, {term: effect} if effect is not None else None):
        f = _refit(model, g)
        hits += 2 * tails.norm_sf(abs(f.solved.beta[at]) / f.std_errors()[at]) < alpha
    low, high = tails.wilson(hits, n)
    return {"power": hits / n, "low": low, "high": high, "n": n}


def power_curve(model: LmerResult, term: str, effects: list[float], **options) -> DataFrame:
    rows = [(float(e), *[float(power(model, term, e, **options)[k]) for k in ("power", "low", "high")]) for e in effects]
    return model.source.sparkSession.createDataFrame(rows, "effect double, power double, low double, high double")


def cross_validate(formula: str, data: DataFrame, key: str, folds: int = 5, seed: int = 0, **options) -> DataFrame:
    """Out-of-fold scores, a row a fold. Folds are hashes of ``key``; with a grouping factor as the key, whole groups
    are left out and predicted from the fixed part."""
    rows = data.withColumn("__fold", grouped.fold_of(F.col(key), folds, seed))
    out = []
    for i in range(folds):
        model = lmer(formula, rows.where(F.col("__fold") != i), **options)
        test = model.predict(rows.where(F.col("__fold") == i), allow_new_levels=True).withColumn("__y", F.col(f"`{model.formula.response}`").cast("double")).dropna(subset=["__y", "fit"])
        s = grouped.weighted_metrics(test, "__y", "fit").first()
        out.append((i, model.nobs(), test.count(), model.converged, model.is_singular(), s.mse, s.rmse, s.mae, s.r2))
    return data.sparkSession.createDataFrame(out, "fold int, n_train long, n_test long, converged boolean, singular boolean, mse double, rmse double, mae double, r2 double")


def profile(model: LmerResult, which: int, points: int = 15, spread: float = 3.0) -> DataFrame:
    """The signed root of the deviance's rise as one parameter of theta is fixed and the others are optimised."""
    from lamina.operators.optimise import minimise

    ml = model.refit_ml()
    at, bounds = ml.theta[which], ml.layout.bounds()
    h = max(1e-4, 1e-3 * abs(at))
    e = np.eye(len(ml.theta))[which] * h
    curve = max(1e-8, (ml.criterion(ml.theta + e) - 2 * ml.deviance() + ml.criterion(np.maximum(ml.theta - e, [b[0] for b in bounds]))) / (h * h))
    rows, rest = [], [i for i in range(len(ml.theta)) if i != which]
    for v in np.linspace(max(bounds[which][0], at - spread * math.sqrt(2 / curve)), at + spread * math.sqrt(2 / curve), points):
        def fixed(free: np.ndarray, v: float = v) -> float:
            theta = np.empty(len(ml.theta))
            theta[which], theta[rest] = v, free
            found = ml.criterion(theta)
            return found if math.isfinite(found) else 1e10

        value = minimise(fixed, ml.theta[rest], [bounds[i] for i in rest]).value if rest else fixed(np.zeros(0))
        rows.append((which, float(v), float(math.copysign(math.sqrt(max(0.0, value - ml.deviance())), v - at))))
    return model.source.sparkSession.createDataFrame(rows, "parameter int, value double, zeta double")


def profile_interval(profile_rows: list, level: float = 0.95) -> tuple[float, float]:
    """Where a profile crosses the normal quantiles, by linear interpolation; the ends where it does not."""
    z = tails.norm_ppf(0.5 + level / 2)
    rows = sorted(profile_rows, key=lambda r: r.value)
    return tuple(float(np.interp(q, [r.zeta for r in rows], [r.value for r in rows])) for q in (-z, z))


def em_reml(model_formula: str, data: DataFrame, iterations: int = 200, tol: float = 1e-8, **options) -> tuple[np.ndarray, float, int]:
    """Variance components of one random term by expectation-maximisation on the level sums: covariance, sigma2, rounds."""
    from lamina.operators.lmm import Layout, solve
    from lamina.plans.frame import prepare

    prep = prepare(model_formula, data, **options)
    g = gram(prep)
    if len(prep.random) != 1:
        raise ValueError("one random term")
    k, levels = len(prep.z_names[0]), len(g.keys[0])
    layout, relative, last = Layout((k,), ("us",)), np.eye(k), math.inf
    for turn in range(1, iterations + 1):
        low = np.linalg.cholesky(relative + 1e-12 * np.eye(k))
        s = solve(low[np.tril_indices(k)], g, layout, True)
        proj = np.einsum("gij,gjp->gip", s.cond_var[0], g.zx[0])
        spread = s.cond_var[0] + np.einsum("gip,pq,gjq->gij", proj, s.unscaled_vcov, proj)
        sigma = s.u[0].T @ s.u[0] / levels + s.sigma2 * spread.mean(0)
        relative = sigma / s.sigma2
        if abs(last - s.deviance) <= tol * (abs(s.deviance) + 1):
            break
        last = s.deviance
    return sigma, s.sigma2, turn


def template(spark, factors: dict[str, int], per_cell: int = 1) -> DataFrame:
    """A balanced design: every combination of the factors' levels, ``per_cell`` rows each, with a row id."""
    total = math.prod(factors.values()) * per_cell
    rows, step = spark.range(total).withColumnRenamed("id", "row"), per_cell
    for name, n in factors.items():
        rows = rows.withColumn(name, F.concat(F.lit(f"{name}"), ((F.floor(F.col("row") / step) % n) + 1).cast("string")))
        step *= n
    return rows


def simulate_formula(formula: str, data: DataFrame, beta: list[float], theta: list[float], sigma: float, seed: int = 0) -> DataFrame:
    """``data`` prepared for ``formula`` with a simulated response ``sim``; needs no response column in the data."""
    from lamina.operators.lmm import layout_of
    from lamina.plans.formula import parse
    from lamina.plans.frame import prepare

    f = parse(formula)
    prep = prepare(f, data if f.response in data.columns else data.withColumn(f.response, F.lit(0.0)))
    if len(beta) != prep.p:
        raise ValueError(f"{prep.p} coefficients: {', '.join(prep.x_names)}")
    total = F.col("o")
    for i, b in enumerate(beta):
        total = total + float(b) * F.col(f"x{i}")
    for k, low in enumerate(layout_of(prep).factors(np.asarray(theta, float))):
        drawn = [_normal_of(F.col(f"g{k}"), seed, 100 * k + i) for i in range(low.shape[0])]
        for i, z in enumerate(random_names(prep, k)):
            total = total + sigma * sum((float(low[i, j]) * drawn[j] for j in range(i + 1)), F.lit(0.0)) * F.col(z)
    return prep.data.withColumn("sim", total + sigma * F.randn(seed) / F.sqrt("w"))
