"""Adjusted predictions and contrasts of marginal means over small reference grids."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.operators.inference import emmeans
from lamina.plans.frame import Encoder


def _inverse(model):
    return (lambda eta: model.family.mean(eta)) if hasattr(model, "family") else (lambda eta: eta)


def adjusted_predictions(model, terms: str | list[str], at: dict[str, list] | None = None, kind: str = "response", level: float = 0.95, points: int = 5) -> DataFrame:
    """Predictions of the fixed part over a grid of ``terms``: the levels of factors, ``points`` quantiles of numbers (or the
    values in ``at``); other factors are at their first level, other numbers at their mean. Columns: the terms,
    predicted, std_error, conf_low, conf_high; intervals are made on the link scale."""
    terms = [terms] if isinstance(terms, str) else list(terms)
    at, formula, source = dict(at or {}), model.formula, model.source
    names = list(dict.fromkeys(f.name for t in formula.fixed for f in t))
    if unknown := [t for t in terms if t not in names]:
        raise ValueError(f"not in the fixed part: {', '.join(unknown)}")
    levels = model.prep.levels
    numeric = [n for n in names if n not in levels and n not in at]
    if numeric:
        shares = [i / (points - 1) for i in range(points)] if points > 1 else [0.5]
        rows = source.select(formula.variables).dropna()
        found = rows.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(numeric)], *[F.percentile_approx(n, shares, 10_000).alias(f"q{i}") for i, n in enumerate(numeric)]).first()
        for i, n in enumerate(numeric):
            at[n] = sorted({float(v) for v in found[f"q{i}"]}) if n in terms else [float(found[f"m{i}"])]
    values = [at[n] if n in at else levels[n] if n in terms else levels[n][:1] for n in names]
    grid = list(itertools.product(*values))
    frame = source.sparkSession.createDataFrame([(i, *g) for i, g in enumerate(grid)], ["__i", *names])
    encode = Encoder(frame, model.prep.contrasts, dict(levels))
    x = [r for r in frame.select("__i", F.array(*[c for _, c in encode.terms(formula.fixed)]).alias("x")).collect()]
    matrix = np.array([r["x"] for r in sorted(x, key=lambda r: r["__i"])])
    beta, inverse = np.array(list(model.fixef().values())), _inverse(model) if kind == "response" else (lambda eta: eta)
    eta, se = matrix @ beta, np.sqrt(np.einsum("ip,pq,iq->i", matrix, model.vcov(), matrix))
    z = tails.norm_ppf(0.5 + level / 2)
    columns = [np.asarray(inverse(v)) for v in (eta, eta - z * se, eta + z * se)]
    slope = 1 / np.asarray(model.family.link.slope(columns[0])) if kind == "response" and hasattr(model, "family") else np.ones(len(eta))
    rows = [(*[g[names.index(t)] for t in terms], float(a), float(s * abs(d)), float(min(lo, hi)), float(max(lo, hi))) for g, a, s, d, lo, hi in zip(grid, columns[0], se, slope, columns[1], columns[2], strict=True)]
    return source.sparkSession.createDataFrame(rows, [*terms, "predicted", "std_error", "conf_low", "conf_high"])


def all_effects(model, **options) -> dict[str, DataFrame]:
    """Adjusted predictions of every variable of the fixed part."""
    return {n: adjusted_predictions(model, n, **options) for n in dict.fromkeys(f.name for t in model.formula.fixed for f in t)}


def contrast(model, specs: str | list[str], method: str | np.ndarray | dict[str, list[float]] = "pairwise", adjust: str = "none", df: float = math.inf, at: dict[str, list] | None = None) -> DataFrame:
    """Contrasts of marginal means: pairwise, trt.vs.ctrl (against the first), consecutive, effects (against their mean), or rows
    of coefficients. Columns: contrast, estimate, std_error, t_ratio, p_value (adjusted)."""
    cells, means, _, matrix = emmeans(model, specs, at)
    names, k = ["/".join(map(str, c)) for c in cells], len(cells)
    eye = np.eye(k)
    if isinstance(method, dict):
        rows, labels = np.array(list(method.values()), float), list(method)
    elif not isinstance(method, str):
        rows = np.atleast_2d(np.asarray(method, float))
        labels = [f"c{i + 1}" for i in range(len(rows))]
    elif method == "pairwise":
        at_ = list(itertools.combinations(range(k), 2))
        rows, labels = np.array([eye[i] - eye[j] for i, j in at_]), [f"{names[i]} - {names[j]}" for i, j in at_]
    elif method == "trt.vs.ctrl":
        rows, labels = eye[1:] - eye[0], [f"{n} - {names[0]}" for n in names[1:]]
    elif method == "consecutive":
        rows, labels = eye[1:] - eye[:-1], [f"{b} - {a}" for a, b in itertools.pairwise(names)]
    elif method == "effects":
        rows, labels = eye - 1 / k, [f"{n} effect" for n in names]
    else:
        raise ValueError(f"unknown contrasts {method!r}")
    if rows.shape[1] != k:
        raise ValueError(f"{k} marginal means need {k} coefficients")
    by = rows @ matrix
    estimate, se = rows @ means, np.sqrt(np.einsum("ip,pq,iq->i", by, model.vcov(), by))
    ratio = estimate / se
    p = [tails.t_two_sided(t, df) for t in ratio]
    adjusted = [tails.studentized_range_sf(abs(t) * math.sqrt(2), k, df) for t in ratio] if adjust == "tukey" else p if adjust == "none" else tails.adjust(p, adjust)
    return model.source.sparkSession.createDataFrame([(n, float(e), float(s), float(t), float(a)) for n, e, s, t, a in zip(labels, estimate, se, ratio, adjusted, strict=True)], "contrast string, estimate double, std_error double, t_ratio double, p_value double")
