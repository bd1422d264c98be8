"""Conversions between covariances, correlations and parameters, and quadrature rules."""

from __future__ import annotations

import math

import numpy as np


def sdcor2cov(sd: np.ndarray, corr: np.ndarray | None = None) -> np.ndarray:
    sd = np.asarray(sd, float)
    return np.outer(sd, sd) * (np.eye(len(sd)) if corr is None else np.asarray(corr, float))


def cov2sdcor(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cov = np.asarray(cov, float)
    if not np.allclose(cov, cov.T) or (np.diag(cov) < 0).any():
        raise ValueError("not a covariance matrix")
    sd = np.sqrt(np.diag(cov))
    scale = np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1)
    return sd, np.where(np.eye(len(sd)) > 0, 1.0, cov / scale)


def safe_chol(x: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Cholesky factor; eigenvalues under tol are lifted to it first if that is needed."""
    try:
        return np.linalg.cholesky(x)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh((x + x.T) / 2)
        return np.linalg.cholesky(vectors @ np.diag(np.maximum(values, tol)) @ vectors.T)


def theta_to_cov(theta: np.ndarray, q: int, sigma: float = 1.0) -> np.ndarray:
    """Row-major lower triangle of the relative factor -> covariance matrix."""
    low = np.zeros((q, q))
    low[np.tril_indices(q)] = theta
    return sigma**2 * low @ low.T


def cov_to_theta(cov: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    return safe_chol(np.asarray(cov, float) / sigma**2)[np.tril_indices(len(cov))]


def gauss_hermite(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights for the standard normal density."""
    nodes, weights = np.polynomial.hermite.hermgauss(n)
    return nodes * math.sqrt(2), weights / math.sqrt(math.pi)


def gauss_hermite_grid(d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The tensor product of the rule in d dimensions."""
    nodes, weights = gauss_hermite(n)
    grid = np.stack(np.meshgrid(*[nodes] * d, indexing="ij"), -1).reshape(-1, d)
    return grid, np.prod(np.stack(np.meshgrid(*[weights] * d, indexing="ij"), -1).reshape(-1, d), 1)


def matrices_to_vector(some: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.asarray(m, float).flatten(order="F") for m in some]) if some else np.zeros(0)


def vector_to_matrices(vector: np.ndarray, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    if sum(a * b for a, b in shapes) != len(vector):
        raise ValueError("the shapes need another number of values")
    cuts = np.cumsum([a * b for a, b in shapes])[:-1]
    return [part.reshape(shape, order="F") for part, shape in zip(np.split(np.asarray(vector, float), cuts), shapes, strict=True)]


def cov_vector(theta: np.ndarray, q: int, sigma: float = 1.0) -> np.ndarray:
    """Row-major lower triangle of the relative factor -> that of the covariance matrix."""
    return theta_to_cov(theta, q, sigma)[np.tril_indices(q)]


def theta_vector(cov: np.ndarray, q: int, sigma: float = 1.0) -> np.ndarray:
    """The inverse; a matrix that is not positive definite is mended first."""
    return cov_to_theta(lower_to_full(cov, q), sigma)


def lower_to_full(vector: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((q, q))
    out[np.tril_indices(q)] = vector
    return out + np.tril(out, -1).T


def sdcor_vector(cov: np.ndarray, q: int) -> np.ndarray:
    """Lower triangle of a covariance -> standard deviations on the diagonal, correlations below it."""
    sd, corr = cov2sdcor(lower_to_full(cov, q))
    return (np.tril(corr, -1) + np.diag(sd))[np.tril_indices(q)]


def cov_of_sdcor(vector: np.ndarray, q: int) -> np.ndarray:
    """The inverse of ``sdcor_vector``."""
    full = lower_to_full(vector, q)
    sd = np.diag(full).copy()
    np.fill_diagonal(full, 1.0)
    return sdcor2cov(sd, full)[np.tril_indices(q)]


def vector_to_triangles(vector: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    """A parameter vector as lower triangular matrices of the given widths."""
    sizes = [w * (w + 1) // 2 for w in widths]
    if sum(sizes) != len(vector):
        raise ValueError("the widths need another number of values")
    return [np.tril(lower_to_full(part, w)) for part, w in zip(np.split(np.asarray(vector, float), np.cumsum(sizes)[:-1]), widths, strict=True)]


def scale_vcov(vcov: np.ndarray, center: np.ndarray | None = None, scale: np.ndarray | None = None) -> np.ndarray:
    """The covariance of coefficients (intercept first) after each covariate x became (x - center) / scale."""
    p = len(vcov)
    center = np.zeros(p - 1) if center is None else np.asarray(center, float)
    scale = np.ones(p - 1) if scale is None else np.asarray(scale, float)
    change = np.diag(np.append(1.0, scale))
    change[0, 1:] = center
    return change @ vcov @ change.T


def components(theta: np.ndarray, widths: list[int], sigma: float = 1.0, to: str = "sdcor") -> list[dict[str, np.ndarray]]:
    """Each term's standard deviations and correlations (sdcor), or variances and covariances (varcov)."""
    out = []
    for low in vector_to_triangles(theta, widths):
        cov = sigma**2 * low @ low.T
        sd, corr = cov2sdcor(cov)
        out.append({"sd": sd, "corr": corr} if to == "sdcor" else {"variance": np.diag(cov), "cov": cov})
    return out
