"""Linear mixed models with one random term whose levels are too many for the driver.

The per-level sums stay on the cluster. An evaluation of the criterion maps over them and returns one small row a
partition; the effects at the optimum are a DataFrame of levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lamina.operators.gram import level_table, totals
from lamina.operators.lmm import layout_of
from lamina.operators.optimise import minimise
from lamina.plans.frame import prepare


@dataclass
class LargeFit:
    names: list[str]
    theta: np.ndarray
    beta: np.ndarray
    sigma2: float
    vcov: np.ndarray
    deviance: float
    evaluations: int
    effects: DataFrame  # level, u

    def fixef(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist(), strict=True))


def _blocks(frame: pd.DataFrame, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.array(frame[c].to_list()).reshape(-1, *shape) for c, shape in (("zz", (k, k)), ("zx", (k, p)), ("zy", (k,))))


def _whiten(frame: pd.DataFrame, lam: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cholesky factors of each level's system, and the design and response sums solved by them."""
    k = lam.shape[0]
    zz, zx, zy = _blocks(frame, k, p)
    chol = np.linalg.cholesky(lam.T @ zz @ lam + np.eye(k))
    rhs = np.linalg.solve(chol, np.concatenate([lam.T @ zx, (zy @ lam)[:, :, None]], 2))
    return chol, rhs[:, :, :p], rhs[:, :, p]


def lmer_large(formula: str, data: DataFrame, reml: bool = True, limit: int = 200, **options) -> LargeFit:
    """Fit ``formula`` with any number of levels. Level sums are computed once and kept by the cluster's storage."""
    prep = prepare(formula, data, **options)
    if len(prep.random) != 1:
        raise ValueError("one random term")
    n, log_w, xx, xy, yy = totals(prep)
    layout, p = layout_of(prep), prep.p
    table = level_table(prep, 0).select("key", "zz", "zx", "zy").persist()

    def parts(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        lam = layout.factors(theta)[0]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(p * p + p + 2)
            for frame in batches:
                if len(frame):
                    chol, r, c = _whiten(frame, lam, p)
                    total += np.concatenate([np.einsum("gka,gkb->ab", r, r).reshape(-1), np.einsum("gka,gk->a", r, c), [(c * c).sum(), 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum()]])
            yield pd.DataFrame({"s": [total.tolist()]})

        s = np.sum([r.s for r in table.mapInPandas(run, "s array<double>").collect()], axis=0)
        return s[: p * p].reshape(p, p), s[p * p : p * p + p], float(s[-2]), float(s[-1])

    def solved(theta: np.ndarray):
        rr, rc, cc, log_det = parts(theta)
        a = xx - rr
        beta = np.linalg.solve(a, xy - rc)
        pwrss, dof = yy - cc - float(beta @ (xy - rc)), n - p if reml else n
        sigma2 = pwrss / dof
        value = dof * (1 + math.log(2 * math.pi * sigma2)) + log_det - log_w + (np.linalg.slogdet(a)[1] if reml else 0.0)
        return value, beta, sigma2, sigma2 * np.linalg.inv(a)

    def criterion(theta: np.ndarray) -> float:
        try:
            return solved(theta)[0]
        except (np.linalg.LinAlgError, ValueError):
            return 1e10

    best = minimise(criterion, layout.start(), layout.bounds(), tol=1e-10, limit=limit)
    value, beta, sigma2, vcov = solved(best.x)
    lam = layout.factors(best.x)[0]

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                chol, r, c = _whiten(frame, lam, p)
                u = np.linalg.solve(np.swapaxes(chol, 1, 2), (c - r @ beta)[:, :, None])[:, :, 0] @ lam.T
                yield pd.DataFrame({"level": frame["key"], "u": u.tolist()})

    return LargeFit(prep.x_names, best.x, beta, sigma2, vcov, value, best.evaluations, table.mapInPandas(effects, "level string, u array<double>"))
