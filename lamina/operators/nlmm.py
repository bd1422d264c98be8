"""Nonlinear mixed models: penalised nonlinear least squares inside the profiled criterion.

Rows with equal x, y and group are one row with a count, summed by the engine; what is left is checked against a bound
before it is read. Each inner step is the linear mixed model of the curve's gradient, solved with its cross-products.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.operators.glmm import MAX_ROWS
from lamina.operators.gram import Gram
from lamina.operators.lmm import Layout, Solved, solve
from lamina.operators.nonlinear import CURVES, Curve
from lamina.operators.optimise import minimise


@dataclass
class NlmerResult:
    curve: Curve
    names: tuple[str, str, str]
    random: list[str]
    keys: list[str]
    theta: np.ndarray
    phi: np.ndarray
    b: np.ndarray  # levels x random parameters
    sigma2: float
    value: float
    n: int
    converged: bool
    vcov_: np.ndarray
    source: DataFrame = field(repr=False)
    cond_var: np.ndarray | None = field(default=None, repr=False)  # levels x k x k, without sigma2
    zx: np.ndarray | None = field(default=None, repr=False)  # of the linearised curve

    def fixef(self) -> dict[str, float]:
        return dict(zip(self.curve.parameters, self.phi.tolist(), strict=True))

    @property
    def sigma(self) -> float:
        return math.sqrt(self.sigma2)

    def vcov(self) -> np.ndarray:
        return self.vcov_

    def npar(self) -> int:
        return len(self.phi) + len(self.theta) + 1

    def nobs(self) -> int:
        return self.n

    def deviance(self) -> float:
        return self.value

    def log_lik(self) -> float:
        return -self.value / 2

    def aic(self) -> float:
        return self.value + 2 * self.npar()

    def bic(self) -> float:
        return self.value + math.log(self.n) * self.npar()

    def ranef(self) -> DataFrame:
        return self.source.sparkSession.createDataFrame([(k, *map(float, b)) for k, b in zip(self.keys, self.b, strict=True)], ["level", *self.random])

    def predict(self, new: DataFrame, random: bool = True) -> DataFrame:
        """``new`` with a column ``fit``; unseen groups have no effects."""
        x, _, group = self.names
        parameters = {n: F.lit(float(v)) for n, v in self.fixef().items()}
        data = new
        if random:
            table = self.ranef().select(F.col("level").alias("__g"), *[F.col(n).alias(f"__{n}") for n in self.random])
            data = new.withColumn("__g", F.col(group).cast("string")).join(F.broadcast(table) if len(self.keys) <= 200_000 else table, "__g", "left")
            for n in self.random:
                parameters[n] = parameters[n] + F.coalesce(F.col(f"__{n}"), F.lit(0.0))
        from lamina.functions.families import SPARK

        return data.withColumn("fit", self.curve.value(SPARK, F.col(x).cast("double"), *parameters.values())).drop("__g", *[f"__{n}" for n in self.random])

    @property
    def layout(self) -> Layout:
        return Layout((len(self.random),), ("us",))

    def ngrps(self) -> dict[str, int]:
        return {self.names[2]: len(self.keys)}

    def df_residual(self) -> int:
        return self.n - self.npar()

    def extract_aic(self) -> tuple[int, float]:
        return self.npar(), self.aic()

    def is_singular(self, tol: float = 1e-4) -> bool:
        low = self.layout.factors(self.theta)[0]
        return bool(np.linalg.eigvalsh(low @ low.T).min() < tol * tol)

    def covariances(self) -> list[np.ndarray]:
        low = self.layout.factors(self.theta)[0]
        return [self.sigma2 * low @ low.T]

    def var_corr(self) -> list[dict]:
        cov = self.covariances()[0]
        sd = np.sqrt(np.diag(cov))
        return [{"group": self.names[2], "names": self.random, "variance": np.diag(cov), "sd": sd, "cov": cov, "corr": cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1)}]

    def coef(self) -> DataFrame:
        """Every group's parameters of the curve."""
        table = self.ranef()
        return table.select("level", *[(F.col(n) + float(v) if n in self.random else F.lit(float(v))).alias(n) for n, v in self.fixef().items()])

    def model_frame(self) -> DataFrame:
        return self.source.select(*self.names).dropna()

    def residuals(self, kind: str = "response") -> DataFrame:
        """The rows with ``fit`` and ``resid``: response, or pearson (over sigma)."""
        if kind not in ("response", "pearson"):
            raise ValueError(f"unknown residuals {kind!r}")
        rows = self.predict(self.model_frame())
        return rows.withColumn("resid", (F.col(self.names[1]) - F.col("fit")) / (self.sigma if kind == "pearson" else 1.0))

    def fitted(self) -> DataFrame:
        return self.predict(self.model_frame())

    def confint(self, level: float = 0.95) -> dict[str, tuple[float, float]]:
        z = tails.norm_ppf(0.5 + level / 2)
        return {n: (b - z * s, b + z * s) for (n, b), s in zip(self.fixef().items(), np.sqrt(np.diag(self.vcov_)).tolist(), strict=True)}

    def glance(self) -> DataFrame:
        row = (type(self).__name__, self.n, len(self.keys), self.npar(), self.df_residual(), self.sigma, self.log_lik(), self.deviance(), self.aic(), self.bic(), self.converged, self.is_singular())
        return self.source.sparkSession.createDataFrame([row], "model string, nobs long, n_groups long, npar int, df_residual long, sigma double, log_lik double, deviance double, aic double, bic double, converged boolean, singular boolean")

    def simulate(self, seed: int = 0, random: bool = True) -> DataFrame:
        """The rows with ``sim``: the curve at new group effects (or, without ``random``, at the fitted ones) and new noise."""
        from lamina.functions.families import SPARK
        from lamina.operators.lmm import _normal_of

        x, _, group = self.names
        if not random:
            return self.predict(self.model_frame()).withColumn("sim", F.col("fit") + self.sigma * F.randn(seed)).drop("fit")
        low = self.layout.factors(self.theta)[0]
        parameters = {k: F.lit(float(v)) for k, v in self.fixef().items()}
        drawn = [_normal_of(F.col(group).cast("string"), seed, j) for j in range(len(self.random))]
        for a, name in enumerate(self.random):
            parameters[name] = parameters[name] + self.sigma * sum((float(low[a, j]) * drawn[j] for j in range(a + 1)), F.lit(0.0))
        return self.model_frame().withColumn("sim", self.curve.value(SPARK, F.col(x).cast("double"), *parameters.values()) + self.sigma * F.randn(seed))

    def update(self, data: DataFrame | None = None, random: list[str] | None = None, start: list[float] | None = None) -> NlmerResult:
        x, y, group = self.names
        return nlmer(self.curve, data if data is not None else self.source, x, y, group, random or self.random, start or list(map(float, self.phi)))

    def refit(self, response: str, data: DataFrame | None = None) -> NlmerResult:
        """The same curve for another response column."""
        x, _, group = self.names
        return nlmer(self.curve, data if data is not None else self.source, x, response, group, self.random, list(map(float, self.phi)))

    def leverages(self) -> DataFrame:
        """The rows with ``fit``, ``resid``, ``hat`` and ``cooks``, of the curve linearised at the estimates."""
        from lamina.functions.families import SPARK
        from lamina.operators.shared import with_hat

        x, y, _ = self.names
        rows = self.residuals().withColumn("g0", F.col(self.names[2]).cast("string"))
        table = self.ranef().select(F.col("level").alias("g0"), *[F.col(n).alias(f"__{n}") for n in self.random])
        rows = rows.join(F.broadcast(table) if len(self.keys) <= 200_000 else table, "g0")
        at = [F.lit(float(v)) + (F.col(f"__{n}") if n in self.random else F.lit(0.0)) for n, v in self.fixef().items()]
        for i, v in enumerate(self.phi):
            h = 1e-6 * max(1.0, abs(float(v)))
            up, down = [*at], [*at]
            up[i], down[i] = at[i] + h, at[i] - h
            rows = rows.withColumn(f"x{i}", (self.curve.value(SPARK, F.col(x).cast("double"), *up) - self.curve.value(SPARK, F.col(x).cast("double"), *down)) / (2 * h))
        for i, n in enumerate(self.random):
            rows = rows.withColumn(f"z0_{i}", F.col(f"x{self.curve.parameters.index(n)}"))
        p = len(self.phi)
        rows = with_hat(rows, p, self.vcov_ / self.sigma2, F.lit(1.0), self.keys, self.cond_var, self.zx)
        out = rows.withColumn("cooks", F.col("resid") ** 2 / (p * self.sigma2) * F.col("hat") / (1 - F.col("hat")) ** 2)
        return out.drop("lean", "g0", *[f"x{i}" for i in range(p)], *[f"z0_{i}" for i in range(len(self.random))], *[f"__{n}" for n in self.random])

    def summary(self) -> str:
        lines = [f"Nonlinear mixed model: {self.curve.name}", f"deviance {self.value:.4f}, {self.n} observations, groups {self.ngrps()}"]
        lines += [f"  {v['group']}: " + ", ".join(f"{n} sd {s:.5g}" for n, s in zip(v["names"], v["sd"], strict=True)) for v in self.var_corr()] + [f"  residual sd {self.sigma:.5g}"]
        return "\n".join(lines + [f"  {n}: {b:.6g} (se {s:.4g})" for (n, b), s in zip(self.fixef().items(), np.sqrt(np.diag(self.vcov_)), strict=True)])

    def tidy(self) -> DataFrame:
        se = np.sqrt(np.diag(self.vcov_))
        return self.source.sparkSession.createDataFrame([("fixed", n, float(v), float(s), float(v / s)) for (n, v), s in zip(self.fixef().items(), se, strict=True)], "effect string, term string, estimate double, std_error double, statistic double")


def nlmer(curve: str | Curve, data: DataFrame, x: str, y: str, group: str, random: list[str] | None = None, start: list[float] | None = None) -> NlmerResult:
    """Fit a curve whose ``random`` parameters (by default the first) vary by group, with a full covariance."""
    curve = CURVES[curve] if isinstance(curve, str) else curve
    random = random or [curve.parameters[0]]
    which = [curve.parameters.index(n) for n in random]
    rows = data.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(group).cast("string").alias("g")).dropna()
    frame: pd.DataFrame = rows.groupBy("x", "y", "g").agg(F.count("*").alias("n")).limit(MAX_ROWS + 1).toPandas().sort_values(["g", "x", "y"])
    if len(frame) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} distinct rows")
    if not len(frame):
        raise ValueError("no complete rows")
    keys = sorted(frame["g"].unique())
    level = frame["g"].map({k: i for i, k in enumerate(keys)}).to_numpy()
    xs, ys, w = frame["x"].to_numpy(), frame["y"].to_numpy(), frame["n"].to_numpy(float)
    p, k, layout = len(curve.parameters), len(which), Layout((len(which),), ("us",))
    n = int(w.sum())

    def value_of(phi: np.ndarray, b: np.ndarray) -> np.ndarray:
        par = [np.full(len(xs), v) for v in phi]
        for i, at in enumerate(which):
            par[at] = par[at] + b[level, i]
        return curve.array(xs, par)

    def gradient(phi: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = []
        for i in range(p):
            h = 1e-6 * max(1.0, abs(phi[i]))
            up, down = phi.copy(), phi.copy()
            up[i], down[i] = phi[i] + h, phi[i] - h
            out.append((value_of(up, b) - value_of(down, b)) / (2 * h))
        return np.stack(out, 1)

    def linear(phi: np.ndarray, b: np.ndarray) -> Gram:
        j = gradient(phi, b)
        z = j[:, which]
        target = ys - value_of(phi, b) + j @ phi + (z * b[level]).sum(1)
        sums = lambda a, c: np.stack([np.bincount(level, w * a[:, i] * c[:, m], len(keys)) for i in range(a.shape[1]) for m in range(c.shape[1])], 1).reshape(len(keys), a.shape[1], c.shape[1])
        return Gram(n, 0.0, j.T @ (j * w[:, None]), j.T @ (w * target), float(w @ (target * target)), [keys], [sums(z, z)], [sums(z, j)], [sums(z, target[:, None])[:, :, 0]])

    state = {"phi": np.array(start or curve.start(rows, "x", "y"), float), "b": np.zeros((len(keys), k))}

    def penalised(phi: np.ndarray, b: np.ndarray, lam: np.ndarray) -> float:
        u = np.linalg.lstsq(lam, b.T, rcond=None)[0]
        r = ys - value_of(phi, b)
        return float(w @ (r * r)) + float((u * u).sum())

    def inner(theta: np.ndarray) -> tuple[float, Solved | None]:
        lam = layout.factors(theta)[0]
        phi, b = state["phi"].copy(), state["b"] * 0 if np.linalg.matrix_rank(lam) < k else state["b"].copy()
        with np.errstate(all="ignore"):
            now, s = penalised(phi, b, lam), None
            for _ in range(60):
                s = solve(theta, linear(phi, b), layout, False)
                if s is None:
                    return 1e10, None
                step = 1.0
                while step > 1e-6:
                    phi2, b2 = phi + step * (s.beta - phi), b + step * (s.u[0] - b)
                    after = penalised(phi2, b2, lam)
                    if np.isfinite(after) and after <= now * (1 + 1e-12):
                        break
                    step /= 2
                else:
                    break
                moved, phi, b, now = now - after, phi2, b2, after
                if moved <= 1e-11 * (now + 1e-300):
                    break
        if s is None or not np.isfinite(now) or now <= 0:
            return 1e10, None
        state["phi"], state["b"] = phi, b
        s.beta, s.u, s.sigma2 = phi, [b], now / n
        return n * (1 + math.log(2 * math.pi * now / n)) + s.log_det_l, s

    best = minimise(lambda t: inner(t)[0], layout.start(), layout.bounds(), tol=1e-11, limit=600)
    value, s = inner(best.x)
    if s is None:
        raise ValueError("the curve cannot be fitted from these starting values")
    return NlmerResult(curve, (x, y, group), random, keys, best.x, s.beta, s.u[0], s.sigma2, value, n, best.converged, s.sigma2 * s.unscaled_vcov, data, s.cond_var[0], linear(s.beta, s.u[0]).zx[0])
