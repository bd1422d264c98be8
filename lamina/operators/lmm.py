"""Linear mixed models: the profiled criterion from cross-products, its optimiser, and the fitted model."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.operators.control import Control
from lamina.operators.gram import Gram, gram, random_names
from lamina.operators.optimise import run
from lamina.operators.shared import BROADCAST_LEVELS, Fitted, quadratic, with_hat
from lamina.plans.formula import Formula
from lamina.plans.frame import Encoder, Prepared, group_key, prepare

#: Cells of the rows of a crossed system that are made at once, 32 MB.
ROW_CELLS = 1 << 22


def factor(theta: np.ndarray, width: int, kind: str) -> np.ndarray:
    """The relative covariance factor of one level: a full lower triangle by rows (us), compound symmetry or ar1."""
    if kind == "us":
        out = np.zeros((width, width))
        out[np.tril_indices(width)] = theta
        return out
    scale, rho = theta
    i = np.arange(width)
    corr = np.full((width, width), rho) + (1 - rho) * np.eye(width) if kind == "cs" else rho ** np.abs(i[:, None] - i[None, :])
    return scale * np.linalg.cholesky(corr)


@dataclass(frozen=True)
class Layout:
    """Where each random term's parameters are in theta."""

    widths: tuple[int, ...]
    kinds: tuple[str, ...]

    @property
    def sizes(self) -> list[int]:
        return [w * (w + 1) // 2 if k == "us" or w == 1 else 2 for w, k in zip(self.widths, self.kinds, strict=True)]

    def factors(self, theta: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for w, k, n in zip(self.widths, self.kinds, self.sizes, strict=True):
            out.append(factor(theta[at : at + n], w, "us" if w == 1 else k))
            at += n
        return out

    def start(self) -> np.ndarray:
        parts = [np.eye(w)[np.tril_indices(w)] if k == "us" or w == 1 else np.array([0.5, 0.3]) for w, k in zip(self.widths, self.kinds, strict=True)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def bounds(self, eps: float = 1e-6) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for w, k in zip(self.widths, self.kinds, strict=True):
            if k == "us" or w == 1:
                out += [(0.0 if i == j else -math.inf, math.inf) for i, j in zip(*np.tril_indices(w), strict=True)]
            else:
                out += [(0.0, math.inf), ((-1 / (w - 1) if k == "cs" else -1.0) + eps, 1 - eps)]
        return out

    def diagonal(self, theta: np.ndarray) -> np.ndarray:
        return np.concatenate([np.diag(f) for f in self.factors(theta)]) if self.widths else np.zeros(0)


@dataclass
class Solved:
    deviance: float
    beta: np.ndarray
    sigma2: float
    pwrss: float
    log_det_l: float
    log_det_x: float
    unscaled_vcov: np.ndarray
    u: list[np.ndarray]  # levels x width, on the scale of the response
    cond_var: list[np.ndarray]  # levels x width x width, without sigma2
    wrss: float = 0.0
    ussq: float = 0.0


class Crossed:
    """The system of crossed terms, [[A, B], [B', C]]: A of the term with the most effects, a small block a level, is
    eliminated, and the Schur complement C - B' inv(A) B of all other effects is factored whole. Rows of B are made a
    bounded number of levels at a time, over the other effects that these levels meet."""

    def __init__(self, g: Gram, factors: list[np.ndarray]) -> None:
        self.g, self.factors, p = g, factors, len(g.xy)
        sizes = [z.shape[0] * z.shape[1] for z in g.zz]
        self.first = first = g.largest()
        self.rest = [t for t in range(len(sizes)) if t != first]
        self.starts = dict(zip(self.rest, np.cumsum([0, *[sizes[t] for t in self.rest]]), strict=False))
        self.total, self.k = sum(sizes[t] for t in self.rest), factors[first].shape[0]
        right = [np.concatenate([lam.T @ g.zx[t], (g.zy[t] @ lam)[:, :, None]], 2) for t, lam in enumerate(factors)]
        lam = factors[first]
        self.chol = np.linalg.cholesky(lam.T @ g.zz[first] @ lam + np.eye(self.k))
        self.own = np.linalg.solve(self.chol, right[first])
        schur, other = np.zeros((self.total, self.total)), np.zeros((self.total, p + 1))
        for t in self.rest:
            lam, s = factors[t], self.starts[t]
            n, k = g.zz[t].shape[:2]
            at = s + np.arange(n)[:, None] * k + np.arange(k)
            schur[at[:, :, None], at[:, None, :]] = lam.T @ g.zz[t] @ lam + np.eye(k)
            other[s : s + n * k] = right[t].reshape(n * k, p + 1)
        for (a, b), (i, j, block) in g.cross.items():
            if first not in (a, b):
                rows, cols = self._places(a, i)[:, :, None], self._places(b, j)[:, None, :]
                scaled = factors[a].T @ block @ factors[b]
                schur[rows, cols] = scaled
                schur[np.swapaxes(cols, 1, 2), np.swapaxes(rows, 1, 2)] = np.swapaxes(scaled, 1, 2)
        for at, levels, met in self._rows():
            flat = levels.reshape(-1, len(at))
            schur[np.ix_(at, at)] -= flat.T @ flat
            other[at] -= flat.T @ self.own[met].reshape(-1, p + 1)
        self.low = np.linalg.cholesky(schur)
        self.others = np.linalg.solve(self.low, other)

    def _places(self, t: int, levels: np.ndarray) -> np.ndarray:
        k = self.factors[t].shape[0]
        return self.starts[t] + levels[:, None] * k + np.arange(k)

    def _rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Other effects, inv(chol) B over them, and the levels of the eliminated term, for bounded runs of levels."""
        f, found = self.first, []
        for (a, b), (i, j, block) in self.g.cross.items():
            if f in (a, b):
                mine, t, level, block = (i, b, j, block) if a == f else (j, a, i, np.swapaxes(block, 1, 2))
                order = np.argsort(mine, kind="stable")
                found.append((t, mine[order], level[order], block[order]))
        n = len(self.g.keys[f])
        each = max(1, ROW_CELLS // max(1, self.k * self.total))
        for begin in range(0, n, each):
            met, parts = np.arange(begin, min(n, begin + each)), []
            for t, mine, level, block in found:
                a, b = np.searchsorted(mine, [begin, begin + each])
                parts.append((mine[a:b] - begin, self._places(t, level[a:b]), self.factors[f].T @ block[a:b] @ self.factors[t]))
            at = np.unique(np.concatenate([p[1].reshape(-1) for p in parts]))
            full = np.zeros((len(met), self.k, len(at)))
            for mine, places, scaled in parts:
                full[mine[:, None, None], np.arange(self.k)[None, :, None], np.searchsorted(at, places)[:, None, :]] = scaled
            yield at, np.linalg.solve(self.chol[met], full), met

    def sums(self) -> tuple[float, np.ndarray, np.ndarray, float]:
        """log det L^2 and the products of what the fixed effects and the response have in the random effects' space."""
        log_det = 2 * float(np.log(np.diagonal(self.chol, axis1=1, axis2=2)).sum() + np.log(np.diag(self.low)).sum())
        own = self.own.reshape(-1, self.own.shape[2])
        both = own.T @ own + self.others.T @ self.others
        return log_det, both[:-1, :-1], both[:-1, -1], float(both[-1, -1])

    def effects(self, beta: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of every term the spherical effects, levels x width, and the diagonal blocks of the system's inverse."""
        left = np.append(-beta, 1.0)
        other = np.linalg.solve(self.low.T, self.others @ left)
        inverse = np.linalg.inv(self.low @ self.low.T)
        own, blocks = self.own @ left, np.linalg.inv(self.chol)
        mine = np.swapaxes(blocks, 1, 2) @ blocks
        for at, levels, met in self._rows():
            own[met] -= levels @ other[at]
            back = np.swapaxes(blocks[met], 1, 2) @ levels
            mine[met] += (back @ inverse[np.ix_(at, at)]) @ np.swapaxes(back, 1, 2)
        u, var = [np.zeros(0)] * len(self.factors), [np.zeros(0)] * len(self.factors)
        u[self.first], var[self.first] = np.einsum("gji,gj->gi", blocks, own), mine
        for t in self.rest:
            at = self._places(t, np.arange(len(self.g.keys[t])))
            u[t], var[t] = other[at], inverse[at[:, :, None], at[:, None, :]]
        return u, var


def solve(theta: np.ndarray, g: Gram, layout: Layout, reml: bool = True, details: bool = True) -> Solved | None:
    """The profiled criterion at theta and, with ``details``, everything estimated along with it; None if singular.

    A single term is a batch of small systems, one a level; of crossed terms the largest is eliminated that way, which
    leaves one dense system over the effects of the others.
    """
    p, factors = len(g.xy), layout.factors(theta)
    try:
        if len(factors) == 1:
            lam = factors[0]
            k = lam.shape[0]
            v = lam.T @ g.zz[0] @ lam + np.eye(k)
            chol = np.linalg.cholesky(v)
            rhs = np.linalg.solve(chol, np.concatenate([lam.T @ g.zx[0], (g.zy[0] @ lam)[:, :, None]], 2))
            r, c = rhs[:, :, :p], rhs[:, :, p]
            log_det_l = 2 * float(np.log(np.diagonal(chol, axis1=1, axis2=2)).sum())
            rr, rc, cc = np.einsum("gka,gkb->ab", r, r), np.einsum("gka,gk->a", r, c), float((c * c).sum())
        elif factors:
            crossed = Crossed(g, factors)
            log_det_l, rr, rc, cc = crossed.sums()
        else:
            log_det_l, rr, rc, cc = 0.0, np.zeros((p, p)), np.zeros(p), 0.0
        a = g.xx - rr
        kx = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None
    b = g.xy - rc
    beta = np.linalg.solve(a, b)
    pwrss = g.yy - cc - float(beta @ b)
    dof = g.n - p if reml else g.n
    if pwrss <= 0 or dof <= 0:
        return None
    sigma2 = pwrss / dof
    log_det_x = 2 * float(np.log(np.diag(kx)).sum())
    deviance = dof * (1 + math.log(2 * math.pi * sigma2)) + log_det_l - g.log_w + (log_det_x if reml else 0.0)
    out = Solved(deviance, beta, sigma2, pwrss, log_det_l, log_det_x, np.linalg.inv(a), [], [])
    if details and factors:
        if len(factors) == 1:
            spherical = np.linalg.solve(np.swapaxes(chol, 1, 2), (c - r @ beta)[:, :, None])[:, :, 0]
            inverse = np.linalg.inv(v)
            out.u, out.cond_var = [spherical @ lam.T], [lam @ inverse @ lam.T]
            out.ussq = float((spherical**2).sum())
        else:
            spherical, blocks = crossed.effects(beta)
            out.ussq = float(sum((u**2).sum() for u in spherical))
            out.u = [u @ lam.T for u, lam in zip(spherical, factors, strict=True)]
            out.cond_var = [lam @ v @ lam.T for v, lam in zip(blocks, factors, strict=True)]
    out.wrss = pwrss - out.ussq
    return out


@dataclass
class LmerResult(Fitted):
    """A fitted linear mixed model. Tables of rows or levels are DataFrames; parameters are small arrays."""

    formula: Formula
    prep: Prepared
    gram: Gram
    layout: Layout
    theta: np.ndarray
    solved: Solved
    reml: bool
    converged: bool
    iterations: int
    source: DataFrame = field(repr=False)
    options: dict = field(default_factory=dict, repr=False)

    # parameters
    def fixef(self) -> dict[str, float]:
        return dict(zip(self.prep.x_names, self.solved.beta.tolist(), strict=True))

    @property
    def sigma(self) -> float:
        return math.sqrt(self.solved.sigma2)

    def vcov(self) -> np.ndarray:
        return self.solved.sigma2 * self.solved.unscaled_vcov

    def npar(self) -> int:
        return self.prep.p + len(self.theta) + 1

    def nobs(self) -> int:
        return self.gram.n

    def ngrps(self) -> dict[str, int]:
        return {r.group: len(k) for r, k in zip(self.prep.random, self.gram.keys, strict=True)}

    def df_residual(self) -> int:
        return self.gram.n - self.prep.p

    def deviance(self) -> float:
        return self.solved.deviance

    def log_lik(self) -> float:
        return -self.solved.deviance / 2

    def aic(self) -> float:
        return self.solved.deviance + 2 * self.npar()

    def bic(self) -> float:
        return self.solved.deviance + math.log(self.gram.n) * self.npar()

    def components(self) -> dict[str, float]:
        s = self.solved
        return {"total": s.deviance, "ldL2": s.log_det_l, "ldRX2": s.log_det_x, "wrss": s.wrss, "ussq": s.ussq, "pwrss": s.pwrss, "sigma2": s.sigma2}

    def covariances(self) -> list[np.ndarray]:
        return [self.solved.sigma2 * f @ f.T for f in self.layout.factors(self.theta)]

    # tables
    def _levels(self, k: int) -> DataFrame:
        table = pd.DataFrame({"key": self.gram.keys[k], "u": self.solved.u[k].tolist(), "v": (self.solved.sigma2 * self.solved.cond_var[k]).reshape(len(self.gram.keys[k]), -1).tolist()})
        return self.spark.createDataFrame(table, "key string, u array<double>, v array<double>")

    def ranef(self, k: int = 0) -> DataFrame:
        """level, one column an effect, and its conditional variance."""
        width = len(self.prep.z_names[k])
        return self._levels(k).select(F.col("key").alias("level"), *[F.col("u")[i].alias(n) for i, n in enumerate(self.prep.z_names[k])], *[F.col("v")[i * width + i].alias(f"condvar_{n}") for i, n in enumerate(self.prep.z_names[k])])

    def coef(self, k: int = 0) -> DataFrame:
        fixed = self.fixef()
        return self._levels(k).select(F.col("key").alias("level"), *[(F.col("u")[i] + fixed.get(n, 0.0)).alias(n) for i, n in enumerate(self.prep.z_names[k])])

    def _with_effects(self, data: DataFrame) -> DataFrame:
        """Join each term's effects by level; levels of a checked number are broadcast, more are shuffled."""
        for k in range(len(self.prep.random)):
            levels = self._levels(k).select(F.col("key").alias(f"g{k}"), F.col("u").alias(f"u{k}"))
            levels = F.broadcast(levels) if len(self.gram.keys[k]) <= BROADCAST_LEVELS else levels.hint("merge")
            data = data.join(levels, f"g{k}", "left")
        return data

    def _mean(self, with_random: bool = True):
        total = F.col("o")
        for i, b in enumerate(self.solved.beta.tolist()):
            total = total + b * F.col(f"x{i}")
        if with_random:
            for k in range(len(self.prep.random)):
                for i, z in enumerate(random_names(self.prep, k)):
                    total = total + F.coalesce(F.col(f"u{k}")[i], F.lit(0.0)) * F.col(z)
        return total

    def augmented(self) -> DataFrame:
        """The prepared frame with ``fitted``, ``fixed``, ``residual`` and ``pearson`` columns."""
        data = self._with_effects(self.prep.data).withColumn("fitted", self._mean()).withColumn("fixed", self._mean(False))
        return data.withColumn("residual", F.col("y") - F.col("fitted")).withColumn("pearson", F.sqrt("w") * F.col("residual") / self.sigma)

    def predict(self, new: DataFrame, random: bool = True, allow_new_levels: bool = False, offset: str | None = None, interval: str | None = None, level: float = 0.95) -> DataFrame:
        """``new`` with a column ``fit``. Unseen levels count 0 if allowed and are an error otherwise.

        ``interval`` adds ``se_fit``, ``lower`` and ``upper``: of the mean ("confidence"), or of a new observation
        ("prediction", with the residual variance and, of unseen levels or without ``random``, that of the effects). With
        ``random`` it needs a single random term, whose effects' errors and their covariance with the fixed part count.
        """
        encode = Encoder(new, self.prep.contrasts, dict(self.prep.levels))
        x, data = encode.terms(self.formula.fixed), new
        for name, known in self.prep.levels.items():
            if name in new.columns and new.where(F.col(f"`{name}`").isNotNull() & ~F.col(f"`{name}`").isin(known)).limit(1).count():
                raise ValueError(f"{name} has a level that the model does not know")
        total = F.col(f"`{offset}`").cast("double") if offset else F.lit(0.0)
        for (_, c), b in zip(x, self.solved.beta.tolist(), strict=True):
            total = total + b * c
        if random:
            for k, r in enumerate(self.prep.random):
                levels = self._levels(k).select(F.col("key").alias(f"__g{k}"), F.col("u").alias(f"__u{k}"))
                data = data.withColumn(f"__g{k}", group_key(r)).join(F.broadcast(levels) if len(self.gram.keys[k]) <= BROADCAST_LEVELS else levels, f"__g{k}", "left")
                for i, (_, c) in enumerate(encode.terms(r.terms)):
                    total = total + F.coalesce(F.col(f"__u{k}")[i], F.lit(0.0)) * c
            if not allow_new_levels:
                unseen = F.lit(False)
                for k in range(len(self.prep.random)):
                    unseen = unseen | F.col(f"__u{k}").isNull()
                if data.where(unseen).limit(1).count():
                    raise ValueError("new levels of a grouping factor; allow_new_levels=True gives them no effect")
        data = data.withColumn("fit", total)
        if interval:
            data = self._with_interval(data, encode, x, random, interval, level)
        return data.drop(*[f"__{c}{k}" for c in "gu" for k in range(len(self.prep.random))])

    def _with_interval(self, data: DataFrame, encode: Encoder, x: list, random: bool, interval: str, level: float) -> DataFrame:
        if interval not in ("confidence", "prediction"):
            raise ValueError(f"unknown interval {interval!r}")
        s, lean, extra = self.solved, [c for _, c in x], F.lit(0.0)
        if random and self.prep.random:
            if len(self.prep.random) > 1:
                raise ValueError("intervals with random effects need a single random term")
            k = len(self.prep.z_names[0])
            z = [c for _, c in encode.terms(self.prep.random[0].terms)]
            proj = np.einsum("gij,gjp->gip", s.cond_var[0], self.gram.zx[0])
            table = pd.DataFrame({"__g0": self.gram.keys[0], "__c": s.cond_var[0].reshape(len(proj), -1).tolist(), "__m": proj.reshape(len(proj), -1).tolist()})
            levels = self.spark.createDataFrame(table, "__g0 string, __c array<double>, __m array<double>")
            data = data.join(F.broadcast(levels) if len(table) <= BROADCAST_LEVELS else levels.hint("merge"), "__g0", "left")
            lean = [c - sum((z[i] * F.coalesce(F.col("__m")[i * len(x) + j], F.lit(0.0)) for i in range(k)), F.lit(0.0)) for j, c in enumerate(lean)]
            known = sum((z[i] * F.col("__c")[i * k + j] * z[j] for i in range(k) for j in range(k)), F.lit(0.0))
            fresh = quadratic(z, self.covariances()[0] / s.sigma2) if interval == "prediction" else F.lit(0.0)
            extra = F.coalesce(known, fresh)
        elif interval == "prediction":
            for r, cov in zip(self.prep.random, self.covariances(), strict=True):
                extra = extra + quadratic([c for _, c in encode.terms(r.terms)], cov / s.sigma2)
        mean = s.sigma2 * (quadratic(lean, s.unscaled_vcov) + extra)
        spread = F.sqrt(mean + (s.sigma2 if interval == "prediction" else 0.0))
        z_value = tails.norm_ppf(0.5 + level / 2)
        data = data.withColumn("se_fit", F.sqrt(mean)).withColumn("lower", F.col("fit") - z_value * spread)
        return data.withColumn("upper", F.col("fit") + z_value * spread).drop("__c", "__m")

    def leverages(self) -> DataFrame:
        """augmented() with ``hat`` (a single term, or none), ``cooks``, ``dffits``, and what deleting the row does to the
        fixed effects, at the fitted theta: ``dfbeta`` and ``dfbetas`` (arrays). All are forms in each row's own columns."""
        if len(self.prep.random) > 1:
            raise ValueError("leverages need a single random term")
        s, p = self.solved, self.prep.p
        levels = (self.gram.keys[0], s.cond_var[0], self.gram.zx[0]) if self.prep.random else (None, None, None)
        data = with_hat(self.augmented(), p, s.unscaled_vcov, F.col("w"), *levels)
        left = F.col("w") * F.col("residual") / (1 - F.col("hat"))
        change = [left * sum((float(s.unscaled_vcov[j, i]) * F.col("lean")[i] for i in range(p)), F.lit(0.0)) for j in range(p)]
        data = data.withColumn("cooks", F.col("w") * F.col("residual") ** 2 / (p * s.sigma2) * F.col("hat") / (1 - F.col("hat")) ** 2)
        data = data.withColumn("dffits", F.sqrt(F.col("w") * F.col("hat")) * F.col("residual") / (self.sigma * (1 - F.col("hat"))))
        return data.withColumn("dfbeta", F.array(*change)).withColumn("dfbetas", F.array(*[c / float(e) for c, e in zip(change, self.std_errors(), strict=True)])).drop("lean")

    def residuals(self, kind: str = "response") -> DataFrame:
        """augmented() with a column ``resid``: response, pearson (by the square root of the weight and sigma) or working."""
        found = {"response": F.col("residual"), "working": F.col("residual"), "deviance": F.sqrt("w") * F.col("residual"), "pearson": F.col("pearson")}
        if kind not in found:
            raise ValueError(f"unknown residuals {kind!r}; known: {', '.join(found)}")
        return self.augmented().withColumn("resid", found[kind])

    def tidy(self, conf_level: float | None = None) -> DataFrame:
        """One row a fixed effect: effect, term, estimate, std_error, statistic, p_value (normal), and an interval."""
        rows = []
        z = tails.norm_ppf(0.5 + (conf_level or 0.95) / 2)
        for name, b, se in zip(self.prep.x_names, self.solved.beta.tolist(), self.std_errors().tolist(), strict=True):
            rows.append(("fixed", name, b, se, b / se, 2 * tails.norm_sf(abs(b / se)), b - z * se, b + z * se))
        return self.spark.createDataFrame(rows, "effect string, term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double")

    def glance(self) -> DataFrame:
        row = (type(self).__name__, self.nobs(), int(sum(self.ngrps().values())), len(self.prep.random), self.npar(), self.df_residual(), self.sigma, self.log_lik(), self.deviance(), self.aic(), self.bic(), self.reml, self.converged, self.is_singular(), self.iterations)
        return self.spark.createDataFrame([row], "model string, nobs long, n_groups long, n_grouping_factors int, npar int, df_residual long, sigma double, log_lik double, deviance double, aic double, bic double, reml boolean, converged boolean, singular boolean, n_iter int")

    def refit_ml(self) -> LmerResult:
        return self if not self.reml else _fit(self.formula, self.prep, self.gram, self.layout, False, self.theta, self.source, self.options)

    def reml_criterion(self) -> float:
        """The REML criterion at the estimates; an error for a fit by maximum likelihood."""
        if not self.reml:
            raise ValueError("a fit by maximum likelihood has no REML criterion")
        return self.solved.deviance

    def refitted(self, formula: Formula, data: DataFrame, **changes) -> LmerResult:
        """The model of another formula or data with the same settings."""
        return lmer(formula, data, self.reml, **(self.options | changes))

    def refit(self, response: str, data: DataFrame | None = None) -> LmerResult:
        """The same model for another response column."""
        from dataclasses import replace

        return lmer(replace(self.formula, response=response), data if data is not None else self.source, self.reml, **self.options)

    def criterion(self, theta: np.ndarray) -> float:
        found = solve(np.asarray(theta, float), self.gram, self.layout, self.reml, False)
        return math.inf if found is None else found.deviance

    def update(self, formula: str | None = None, data: DataFrame | None = None) -> LmerResult:
        from lamina.plans.formula import update

        return lmer(update(self.formula, formula) if formula else self.formula, data if data is not None else self.source, self.reml, **self.options)

    def simulate(self, seed: int = 0, random: bool = True) -> DataFrame:
        """The prepared frame with a column ``sim``: new effects for every level and new noise, both drawn by hashes of
        level and seed or by the engine's own generator, so nothing is collected."""
        data = self.prep.data
        total = self._mean(False)
        if random:
            for k, f in enumerate(self.layout.factors(self.theta)):
                drawn = [_normal_of(F.col(f"g{k}"), seed, 100 * k + i) for i in range(f.shape[0])]
                for i, z in enumerate(random_names(self.prep, k)):
                    total = total + self.sigma * sum((float(f[i, j]) * drawn[j] for j in range(i + 1)), F.lit(0.0)) * F.col(z)
        return data.withColumn("sim", total + self.sigma * F.randn(seed) / F.sqrt("w"))

    def summary(self) -> str:
        lines = [f"Linear mixed model fit by {'REML' if self.reml else 'maximum likelihood'}", f"Formula: {self.formula}", f"criterion {self.deviance():.4f}, {self.nobs()} observations, groups {self.ngrps()}"]
        lines += [f"  {v['group']}: " + ", ".join(f"{n} sd {s:.5g}" for n, s in zip(v["names"], v["sd"], strict=True)) for v in self.var_corr()] + [f"  residual sd {self.sigma:.5g}"]
        return "\n".join(lines + [f"  {n}: {b:.6g} (se {s:.4g}, t {b / s:.3f})" for n, b, s in zip(self.prep.x_names, self.solved.beta, self.std_errors(), strict=True)])


def _normal_of(key, seed: int, salt: int):
    """A standard normal number fixed by a key: two uniform hashes through the Box-Muller transform."""
    u = [(F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for i in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def _fit(formula: Formula, prep: Prepared, g: Gram, layout: Layout, reml: bool, start: np.ndarray | None, source: DataFrame, options: dict, control: Control | None = None) -> LmerResult:
    def criterion(theta: np.ndarray) -> float:
        found = solve(theta, g, layout, reml, False)
        return 1e10 if found is None else found.deviance

    if sum(layout.sizes):
        control = control or options.get("control") or Control()
        best = run(criterion, layout.start() if start is None else start, layout.bounds(), control.optimizer, **control.settings())
        theta, converged, iterations = best.x, best.converged, best.evaluations
    else:
        theta, converged, iterations = np.zeros(0), True, 0
    solved = solve(theta, g, layout, reml)
    if solved is None:
        raise ValueError("the design is singular")
    return LmerResult(formula, prep, g, layout, theta, solved, reml, converged, iterations, source, options)


def layout_of(prep: Prepared) -> Layout:
    return Layout(tuple(map(len, prep.z_names)), tuple(r.cov_type for r in prep.random))


def lmer(formula: str | Formula, data: DataFrame, reml: bool = True, weights: str | None = None, offset: str | None = None, na_action: str = "omit", contrasts: dict[str, str] | None = None, start: np.ndarray | None = None, control: Control | None = None) -> LmerResult:
    """Fit a linear mixed model: aggregations over the rows by level, then driver arithmetic on levels."""
    options = {"weights": weights, "offset": offset, "na_action": na_action, "contrasts": contrasts}
    prep = prepare(formula, data, **options)
    options["control"] = control
    return _fit(prep.formula, prep, gram(prep), layout_of(prep), reml, start, data, options)
