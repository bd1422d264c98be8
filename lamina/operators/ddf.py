"""Kenward-Roger inference for models with one random term, from the level sums alone.

V is linear in the entries of the effects' covariance G and in the residual variance, so every matrix that the method
needs is a sum over levels of products of Z'WZ, Z'WX and the level's conditional covariance; no n by n matrix appears.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame

from lamina.functions import tails
from lamina.operators.inference import satterthwaite
from lamina.operators.lmm import LmerResult


def _pieces(model: LmerResult) -> tuple[list[np.ndarray], list[list[np.ndarray]], np.ndarray]:
    """P_r = -X'V^-1 V_r V^-1 X, Q_rs = X'V^-1 V_r V^-1 V_s V^-1 X, and the expected information of the variances."""
    if len(model.prep.random) != 1:
        raise ValueError("Kenward-Roger needs a single random term; use satterthwaite")
    g, s = model.gram, model.solved
    zz, zx, c, v = g.zz[0], g.zx[0], s.cond_var[0], s.sigma2
    k = zz.shape[1]
    t = np.swapaxes
    a = zx - zz @ c @ zx  # Z'V^-1 X, times the residual variance
    b = zz - zz @ c @ zz  # Z'V^-1 Z, likewise
    d1 = 2 * c - c @ zz @ c
    d2 = d1 + c - d1 @ zz @ c
    entries = []
    for i, j in itertools.combinations_with_replacement(range(k), 2):
        e = np.zeros((k, k))
        e[i, j] = e[j, i] = 1.0
        entries.append(e)
    n = len(entries) + 1
    p_, q_, tr = [], [[None] * n for _ in range(n)], np.zeros((n, n))
    for r, e in enumerate(entries):
        p_.append(-(t(a, 1, 2) @ e @ a).sum(0) / v**2)
        for u, f in enumerate(entries):
            q_[r][u] = (t(a, 1, 2) @ e @ b @ f @ a).sum(0) / v**3
            tr[r, u] = np.trace(e @ b @ f @ b, axis1=1, axis2=2).sum() / v**2
        mixed = (t(a, 1, 2) @ e @ (zx - zz @ d1 @ zx)).sum(0) / v**3
        q_[r][n - 1], q_[n - 1][r] = mixed, mixed.T
        tr[r, n - 1] = tr[n - 1, r] = np.trace(e @ (zz - zz @ d1 @ zz), axis1=1, axis2=2).sum() / v**2
    p_.append(-(g.xx - (t(zx, 1, 2) @ d1 @ zx).sum(0)) / v**2)
    q_[n - 1][n - 1] = (g.xx - (t(zx, 1, 2) @ d2 @ zx).sum(0)) / v**3
    tr[n - 1, n - 1] = (g.n - np.trace(d1 @ zz, axis1=1, axis2=2).sum()) / v**2
    phi = model.vcov()
    info = np.array([[0.5 * (tr[r, u] - 2 * np.trace(phi @ q_[r][u]) + np.trace(phi @ p_[r] @ phi @ p_[u])) for u in range(n)] for r in range(n)])
    return p_, q_, info


def kenward_roger(model: LmerResult) -> tuple[np.ndarray, dict[str, float]]:
    """The adjusted covariance of the fixed effects, and the degrees of freedom of each coefficient."""
    if not model.reml:
        raise ValueError("Kenward-Roger needs a REML fit")
    p_, q_, info = _pieces(model)
    w, phi, n = np.linalg.pinv(info), model.vcov(), len(p_)
    inner = sum(w[r, s] * (q_[r][s] - p_[r] @ phi @ p_[s]) for r in range(n) for s in range(n))
    adjusted = phi + 2 * phi @ ((inner + inner.T) / 2) @ phi
    slopes = np.array([np.diag(phi @ p @ phi) for p in p_])  # of each coefficient's variance, per variance parameter
    spread = np.einsum("ri,rs,si->i", slopes, w, slopes) / np.diag(phi) ** 2
    return adjusted, {name: float(2 / x) if x > 0 else float(model.df_residual()) for name, x in zip(model.prep.x_names, spread, strict=True)}


def coefficient_tests(model: LmerResult, method: str = "satterthwaite") -> DataFrame:
    """term, estimate, std_error, df, t, p_value; the degrees of freedom by ``satterthwaite``, ``kenward_roger`` or ``residual``."""
    if method == "kenward_roger":
        cov, df = kenward_roger(model)
    elif method in ("satterthwaite", "residual"):
        cov, df = model.vcov(), satterthwaite(model) if method == "satterthwaite" else dict.fromkeys(model.prep.x_names, float(model.df_residual()))
    else:
        raise ValueError(f"unknown degrees of freedom {method!r}")
    rows = []
    for (name, b), se in zip(model.fixef().items(), np.sqrt(np.diag(cov)).tolist(), strict=True):
        rows.append((name, b, se, float(df[name]), b / se, tails.t_two_sided(b / se, df[name])))
    return model.spark.createDataFrame(rows, "term string, estimate double, std_error double, df double, t double, p_value double")
