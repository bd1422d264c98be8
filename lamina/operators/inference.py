"""Tests, comparisons and marginal means of fitted models. Grids and tables are DataFrames; the algebra is small."""

from __future__ import annotations

import itertools
import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.operators.control import Control, GeneralisedControl
from lamina.operators.lmm import LmerResult, _fit
from lamina.operators.optimise import available
from lamina.plans.formula import show
from lamina.plans.frame import Encoder


def anova(*models, refit: bool = True) -> DataFrame:
    """Sequential likelihood-ratio tests, models ordered by their number of parameters; REML fits are refitted by ML."""
    fitted = sorted((m.refit_ml() if refit and isinstance(m, LmerResult) else m for m in models), key=lambda m: m.npar())
    rows, last = [], None
    for m in fitted:
        chi = None if last is None else max(0.0, 2 * (m.log_lik() - last.log_lik()))
        df = None if last is None else m.npar() - last.npar()
        rows.append((str(m.formula), m.npar(), m.aic(), m.bic(), m.log_lik(), m.deviance(), chi, df, None if chi is None else tails.chi2_sf(chi, df) if df else 1.0))
        last = m
    return fitted[0].source.sparkSession.createDataFrame(rows, "model string, npar int, aic double, bic double, log_lik double, deviance double, chisq double, df int, p_value double")


def droppable(formula) -> list:
    """Terms that no other fixed term contains."""
    fixed = [t for t in formula.fixed if t]
    return [t for t in fixed if not any(set(t) < set(o) for o in fixed)]


def drop1(model) -> DataFrame:
    """Likelihood-ratio tests of every deletable term, on ML fits of the same rows. Linear models reuse the cross-products: a
    deleted term is deleted rows and columns, so the rows are not read again. Others are fitted anew."""
    full = model.refit_ml()
    rows = [("<none>", full.npar(), full.aic(), None, None)]
    for term in droppable(full.formula):
        fixed = tuple(t for t in full.formula.fixed if t != term) or ((),)
        keep = [i for i, t in enumerate(full.prep.assign) if t != show(term)]
        # a factor of a model without intercept changes the coding of others: then the design is made anew
        if isinstance(full, LmerResult) and keep and () in full.formula.fixed:
            reduced = _without(full, keep, replace(full.formula, fixed=fixed))
        else:
            same = full.source.dropna(subset=full.formula.variables)
            reduced = type(full).refitted(full, replace(full.formula, fixed=fixed), same)
        chi, df = max(0.0, 2 * (full.log_lik() - reduced.log_lik())), full.npar() - reduced.npar()
        rows.append((show(term), reduced.npar(), reduced.aic(), chi, tails.chi2_sf(chi, df)))
    return full.source.sparkSession.createDataFrame(rows, "term string, npar int, aic double, lrt double, p_value double")


def _without(model: LmerResult, keep: list[int], formula) -> LmerResult:
    """The ML fit with only some columns of the fixed part."""
    g = model.gram
    part = replace(g, xx=g.xx[np.ix_(keep, keep)], xy=g.xy[keep], zx=[z[:, :, keep] for z in g.zx])
    prep = replace(model.prep, formula=formula, x_names=[model.prep.x_names[i] for i in keep], columns=[model.prep.columns[i] for i in keep], assign=[model.prep.assign[i] for i in keep])
    return _fit(formula, prep, part, model.layout, False, model.theta, model.source, model.options)


def all_fit(model, methods: list[str] | None = None) -> DataFrame:
    """The model fitted with every optimiser, from the same cross-products: optimizer, converged, evaluations, deviance, aic, bic,
    theta, beta, message (of a failure)."""
    rows = []
    for method in methods or available():
        try:
            if isinstance(model, LmerResult):
                f = _fit(model.formula, model.prep, model.gram, model.layout, model.reml, None, model.source, model.options, Control(optimizer=method))
                evaluations = f.iterations
            else:
                f, evaluations = type(model).refitted(model, model.formula, model.source, control=GeneralisedControl(optimizer=method)), None
            rows.append((method, f.converged, evaluations, f.deviance(), f.aic(), f.bic(), list(map(float, f.theta)), list(map(float, f.fixef().values())), None))
        except (ValueError, np.linalg.LinAlgError) as e:
            rows.append((method, False, None, None, None, None, None, None, str(e)))
    return model.source.sparkSession.createDataFrame(rows, "optimizer string, converged boolean, evaluations int, deviance double, aic double, bic double, theta array<double>, beta array<double>, message string")


def best_fit(fits: DataFrame, by: str = "deviance"):
    """The row of all_fit() with the least criterion."""
    return fits.where(F.col(by).isNotNull()).orderBy(by, "optimizer").first()


def is_consistent(fits: DataFrame, tol: float = 1e-3) -> bool:
    """Whether the deviances of all_fit() lie within ``tol``."""
    r = fits.agg((F.max("deviance") - F.min("deviance")).alias("d")).first()
    return r["d"] is not None and r["d"] < tol


def evidence_set(ranked: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The best models of a ranking whose weights together reach the threshold."""
    return ranked.where(F.col("cumulative") - F.col("weight") < threshold)


def linear_hypothesis(model, matrix: np.ndarray, rhs: np.ndarray | float = 0.0, df: float = math.inf) -> dict[str, float]:
    """Wald test of matrix @ beta = rhs: F with the given denominator degrees of freedom, and chi-square."""
    c = np.atleast_2d(np.asarray(matrix, float))
    beta = np.array(list(model.fixef().values()))
    gap = c @ beta - rhs
    q = int(np.linalg.matrix_rank(c))
    chi = float(gap @ np.linalg.pinv(c @ model.vcov() @ c.T) @ gap)
    return {"df": q, "chisq": chi, "f": chi / q, "p_value": tails.f_sf(chi / q, q, df)}


def satterthwaite(model: LmerResult, step: float = 1e-4) -> dict[str, float]:
    """Degrees of freedom of each coefficient: 2 v^2 / var(v), with v's gradient over (theta, sigma) by differences."""
    from lamina.operators.lmm import solve

    def full(par: np.ndarray) -> float:
        s = solve(par[:-1], model.gram, model.layout, model.reml, False)
        if s is None:
            return 1e10
        dof = model.gram.n - model.prep.p if model.reml else model.gram.n
        return dof * math.log(2 * math.pi * par[-1] ** 2) + s.pwrss / par[-1] ** 2 + s.log_det_l + (s.log_det_x if model.reml else 0.0)

    def variances(par: np.ndarray) -> np.ndarray:
        return par[-1] ** 2 * np.diag(solve(par[:-1], model.gram, model.layout, model.reml, False).unscaled_vcov)

    at = np.append(model.theta, model.sigma)
    h = np.maximum(step, step * np.abs(at))
    n = len(at)
    hess = np.zeros((n, n))
    for i, j in itertools.combinations_with_replacement(range(n), 2):
        ei, ej = h[i] * np.eye(n)[i], h[j] * np.eye(n)[j]
        hess[i, j] = hess[j, i] = (full(at + ei + ej) - full(at + ei - ej) - full(at - ei + ej) + full(at - ei - ej)) / (4 * h[i] * h[j])
    cov = 2 * np.linalg.pinv(hess)
    grad = np.stack([(variances(at + h[i] * np.eye(n)[i]) - variances(at - h[i] * np.eye(n)[i])) / (2 * h[i]) for i in range(n)])
    spread = np.einsum("ip,ij,jp->p", grad, cov, grad)
    v = variances(at)
    return {name: float(2 * a * a / s) if s > 0 else math.inf for name, a, s in zip(model.prep.x_names, v, spread, strict=True)}


def criteria(spark: SparkSession, models: dict[str, object], by: str = "aicc") -> DataFrame:
    """Models ranked by an information criterion, with deltas, weights and cumulative weights."""
    rows = [(name, m.npar(), m.nobs(), m.log_lik()) for name, m in models.items()]
    return rank_models(spark.createDataFrame(rows, "model string, npar int, nobs long, log_lik double"), by)


def rank_models(table: DataFrame, by: str = "aicc") -> DataFrame:
    """The same for a table of model, npar, nobs, log_lik."""
    k, n = F.col("npar").cast("double"), F.col("nobs").cast("double")
    table = table.withColumn("aic", -2 * F.col("log_lik") + 2 * k).withColumn("bic", -2 * F.col("log_lik") + F.log(n) * k)
    table = table.withColumn("aicc", F.col("aic") + 2 * k * (k + 1) / (n - k - 1))
    everything, ordered = Window.partitionBy(), Window.orderBy(by, "model")
    table = table.withColumn("delta", F.col(by) - F.min(by).over(everything)).withColumn("raw", F.exp(-F.col("delta") / 2))
    table = table.withColumn("weight", F.col("raw") / F.sum("raw").over(everything)).withColumn("rank", F.row_number().over(ordered))
    return table.withColumn("cumulative", F.sum("weight").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")


def anova_terms(model: LmerResult) -> DataFrame:
    """Wald F tests of whole terms, each with the mean Satterthwaite degrees of freedom of its columns."""
    dof, rows = satterthwaite(model), []
    names = model.prep.x_names
    for term in dict.fromkeys(model.prep.assign):
        at = [i for i, t in enumerate(model.prep.assign) if t == term]
        if term == "(Intercept)":
            continue
        den = float(np.mean([dof[names[i]] for i in at]))
        test = linear_hypothesis(model, np.eye(len(names))[at], df=den)
        rows.append((term, test["df"], den, test["f"], test["p_value"]))
    return model.source.sparkSession.createDataFrame(rows, "term string, num_df int, den_df double, f double, p_value double")


def reference_grid(model, specs: list[str], at: dict[str, list] | None = None) -> tuple[DataFrame, list[str]]:
    """All combinations of factor levels, numeric variables at their means or at the given values: small by construction."""
    source, formula = model.source, model.formula
    names = list(dict.fromkeys(f.name for t in formula.fixed for f in t))
    numeric = [n for n in names if n not in model.prep.levels and n not in (at or {})]
    means = source.select(formula.variables).dropna().agg(*[F.avg(n).alias(n) for n in numeric]).first() if numeric else None
    values = {n: (at or {}).get(n) or model.prep.levels.get(n) or [float(means[n])] for n in names}
    rows = list(itertools.product(*values.values())) or [()]
    return source.sparkSession.createDataFrame(rows, names) if names else source.sparkSession.createDataFrame([(1,)], ["one"]), [n for n in names if n in specs]


def emmeans(model, specs: str | list[str], at: dict[str, list] | None = None) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Marginal means over the reference grid: levels, means, standard errors and the matrix that makes them of beta."""
    specs = [specs] if isinstance(specs, str) else list(specs)
    grid, keys = reference_grid(model, specs, at)
    encode = Encoder(grid, model.prep.contrasts, dict(model.prep.levels))
    cells = grid.select(*keys, *[c.alias(f"x{i}") for i, (_, c) in enumerate(encode.terms(model.formula.fixed))]).groupBy(*keys).agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(model.prep.p)]).orderBy(*keys).collect()
    matrix = np.array([[r[f"x{i}"] for i in range(model.prep.p)] for r in cells])
    beta = np.array(list(model.fixef().values()))
    return [tuple(r[k] for k in keys) for r in cells], matrix @ beta, np.sqrt(np.einsum("ip,pq,iq->i", matrix, model.vcov(), matrix)), matrix


def pairs(model, specs: str | list[str], adjust: str = "tukey", df: float = math.inf) -> DataFrame:
    """All differences of marginal means, with adjusted p-values."""
    levels, means, _, matrix = emmeans(model, specs)
    rows, p, ratios = [], [], []
    for i, j in itertools.combinations(range(len(levels)), 2):
        c = matrix[i] - matrix[j]
        se = math.sqrt(c @ model.vcov() @ c)
        ratios.append((means[i] - means[j]) / se)
        p.append(tails.t_two_sided(ratios[-1], df))
        rows.append((f"{'/'.join(map(str, levels[i]))} - {'/'.join(map(str, levels[j]))}", float(means[i] - means[j]), se))
    adjusted = [tails.studentized_range_sf(abs(t) * math.sqrt(2), len(levels), df) for t in ratios] if adjust == "tukey" else tails.adjust(p, adjust)
    return model.source.sparkSession.createDataFrame([(*r, float(t), a) for r, t, a in zip(rows, ratios, adjusted, strict=True)], "contrast string, estimate double, std_error double, t_ratio double, p_value double")


def adjust_column(table: DataFrame, p: str, method: str) -> DataFrame:
    """Adjusted p-values of a small table as a column ``p_adjusted``: running maxima or minima over ranks."""
    m = F.count("*").over(Window.partitionBy())
    up = Window.orderBy(p)
    rank = F.row_number().over(up)
    if method == "bonferroni":
        return table.withColumn("p_adjusted", F.least(F.lit(1.0), m * F.col(p)))
    table = table.withColumns({"__r": rank, "__m": m})
    if method == "holm":
        raw = F.least(F.lit(1.0), (F.col("__m") - F.col("__r") + 1) * F.col(p))
        return table.withColumn("p_adjusted", F.max(raw).over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))).drop("__r", "__m")
    if method == "fdr":
        raw = F.least(F.lit(1.0), F.col("__m") * F.col(p) / F.col("__r"))
        return table.withColumn("p_adjusted", F.min(raw).over(Window.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0))).drop("__r", "__m")
    raise ValueError(f"unknown adjustment {method!r}")
