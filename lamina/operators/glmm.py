"""Generalised linear mixed models by penalised iteratively reweighted least squares, Laplace or adaptive quadrature.

Rows that agree in response, design, offset and level are one row with summed weight, which one aggregation makes; what
is left is checked against a bound before it is read. Iterations then run in numpy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.functions.families import NUMPY, SPARK, Family
from lamina.functions.families import family as family_of
from lamina.operators.control import GeneralisedControl
from lamina.operators.gram import MAX_CROSSED, fixed_names, random_names
from lamina.operators.lmm import Layout, _normal_of, layout_of
from lamina.operators.optimise import golden, run
from lamina.operators.shared import Fitted, with_hat
from lamina.plans.formula import Formula
from lamina.plans.frame import Encoder, Prepared, group_key, prepare

#: Distinct rows that a fit reads to the driver.
MAX_ROWS = 2_000_000


@dataclass
class Rows:
    y: np.ndarray
    w: np.ndarray
    o: np.ndarray
    x: np.ndarray
    z: list[np.ndarray]
    level: list[np.ndarray]
    keys: list[list[str]]
    n: int


def collapse(prep: Prepared) -> Rows:
    names = ["y", "o", *fixed_names(prep), *[c for k in range(len(prep.random)) for c in (f"g{k}", *random_names(prep, k))]]
    table = prep.data.groupBy(*names).agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    frame = table.limit(MAX_ROWS + 1).toPandas()
    if len(frame) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} distinct rows; round or bin the covariates first")
    frame = frame.sort_values(names).reset_index(drop=True)
    z, level, keys = [], [], []
    for k in range(len(prep.random)):
        known = sorted(frame[f"g{k}"].unique())
        place = {v: i for i, v in enumerate(known)}
        keys.append(known)
        level.append(frame[f"g{k}"].map(place).to_numpy())
        z.append(frame[random_names(prep, k)].to_numpy(float))
    return Rows(frame["y"].to_numpy(float), frame["w"].to_numpy(float), frame["o"].to_numpy(float), frame[fixed_names(prep)].to_numpy(float), z, level, keys, int(frame["n"].sum()))


@dataclass
class State:
    beta: np.ndarray
    u: list[np.ndarray]  # spherical, levels x width
    mu: np.ndarray
    deviance: float  # of the data
    penalty: float
    log_det: float
    unscaled_vcov: np.ndarray
    precision: list[np.ndarray]
    converged: bool

    @property
    def laplace(self) -> float:
        return self.deviance + self.penalty + self.log_det


def pirls(theta: np.ndarray, rows: Rows, fam: Family, layout: Layout, start: State | None = None, iterations: int = 100, tol: float = 1e-10) -> State:
    """Modes of the effects and the fixed part at theta, with step halving. Crossed terms are solved densely."""
    factors = layout.factors(theta)
    widths, counts = [f.shape[0] for f in factors], [len(k) for k in rows.keys]
    starts = np.cumsum([0, *[w * c for w, c in zip(widths, counts, strict=True)]])
    total, p = int(starts[-1]), rows.x.shape[1]
    scaled = [z @ f for z, f in zip(rows.z, factors, strict=True)]

    def eta_of(beta: np.ndarray, u: np.ndarray) -> np.ndarray:
        eta = rows.x @ beta + rows.o
        for t, z in enumerate(scaled):
            eta = eta + (z * u[starts[t] : starts[t + 1]].reshape(counts[t], widths[t])[rows.level[t]]).sum(1)
        return eta

    def value(beta: np.ndarray, u: np.ndarray) -> tuple[float, np.ndarray]:
        mu = fam.mean(eta_of(beta, u), NUMPY)
        return float(fam.deviance(rows.y, mu, rows.w, NUMPY).sum()) + float(u @ u), mu

    if start is None:
        eta = fam.link.link(fam.clamp(fam.start(rows.y)))
        beta = np.linalg.lstsq(rows.x * np.sqrt(rows.w)[:, None], (eta - rows.o) * np.sqrt(rows.w), rcond=None)[0]
        u = np.zeros(total)
    else:
        beta, u = start.beta.copy(), np.concatenate([x.reshape(-1) for x in start.u]) if start.u else np.zeros(0)
    now, mu = value(beta, u)
    converged = False
    for _ in range(iterations):
        slope = fam.link.slope(mu)
        weight = rows.w * fam.weight(mu)
        target = eta_of(beta, u) - rows.o + (rows.y - mu) * slope
        if total and len(factors) == 1:
            k, level = widths[0], rows.level[0]
            zz = np.stack([np.bincount(level, weight * scaled[0][:, i] * scaled[0][:, j], counts[0]) for i in range(k) for j in range(k)], 1).reshape(-1, k, k) + np.eye(k)
            zx = np.stack([np.bincount(level, weight * scaled[0][:, i] * rows.x[:, j], counts[0]) for i in range(k) for j in range(p)], 1).reshape(-1, k, p)
            zy = np.stack([np.bincount(level, weight * scaled[0][:, i] * target, counts[0]) for i in range(k)], 1)
            inner = np.linalg.solve(zz, np.concatenate([zx, zy[:, :, None]], 2))
            a = rows.x.T @ (rows.x * weight[:, None]) - np.einsum("gkp,gkq->pq", zx, inner[:, :, :p])
            b = rows.x.T @ (weight * target) - np.einsum("gkp,gk->p", zx, inner[:, :, p])
            new_beta = np.linalg.solve(a, b)
            new_u = (inner[:, :, p] - inner[:, :, :p] @ new_beta).reshape(-1)
            precision, log_det = [zz], float(np.linalg.slogdet(zz)[1].sum())
        elif total:
            if total > MAX_CROSSED:
                raise ValueError(f"{total} crossed effects; at most {MAX_CROSSED}")
            # every row has a few places in the effects: their products are added where they meet
            columns = [(starts[t] + rows.level[t] * widths[t] + i, z[:, i]) for t, z in enumerate(scaled) for i in range(widths[t])]
            m, zx, zy = np.eye(total), np.zeros((total, p)), np.zeros(total)
            for at, z in columns:
                zy += np.bincount(at, weight * z * target, total)
                for j in range(p):
                    zx[:, j] += np.bincount(at, weight * z * rows.x[:, j], total)
                for other, z2 in columns:
                    np.add.at(m, (at, other), weight * z * z2)
            inner = np.linalg.solve(m, np.column_stack([zx, zy]))
            a = rows.x.T @ (rows.x * weight[:, None]) - zx.T @ inner[:, :p]
            new_beta = np.linalg.solve(a, rows.x.T @ (weight * target) - zx.T @ inner[:, p])
            new_u = inner[:, p] - inner[:, :p] @ new_beta
            precision, log_det = [m], float(np.linalg.slogdet(m)[1])
        else:
            a = rows.x.T @ (rows.x * weight[:, None])
            new_beta, new_u, precision, log_det = np.linalg.solve(a, rows.x.T @ (weight * target)), u, [], 0.0
        step = 1.0
        while True:
            b2, u2 = beta + step * (new_beta - beta), u + step * (new_u - u)
            after, mu2 = value(b2, u2)
            if after <= now + 1e-12 * abs(now) or step < 1e-6:
                break
            step /= 2
        moved, beta, u, mu = abs(now - after), b2, u2, mu2
        now = after
        if moved <= tol * (abs(now) + 1):
            converged = True
            break
    parts = [u[starts[t] : starts[t + 1]].reshape(counts[t], widths[t]) for t in range(len(factors))]
    return State(beta, parts, mu, now - float(u @ u), float(u @ u), log_det, np.linalg.inv(a), precision, converged)


def quadrature(theta: np.ndarray, rows: Rows, fam: Family, layout: Layout, state: State, points: int) -> float:
    """-2 log likelihood by adaptive Gauss-Hermite quadrature; one term with one effect a level."""
    if len(layout.widths) != 1 or layout.widths != (1,):
        raise ValueError("quadrature needs a single random intercept or slope")
    nodes, weights = np.polynomial.hermite.hermgauss(points)
    scale = 1 / np.sqrt(state.precision[0][:, 0, 0])
    lam = layout.factors(theta)[0][0, 0]
    fixed = rows.x @ state.beta + rows.o
    terms = []
    for node, weight in zip(nodes, weights, strict=True):
        u = state.u[0][:, 0] + math.sqrt(2) * scale * node
        mu = fam.mean(fixed + lam * rows.z[0][:, 0] * u[rows.level[0]])
        dev = np.bincount(rows.level[0], fam.deviance(rows.y, mu, rows.w), len(u))
        terms.append(math.log(weight) - dev / 2 - u * u / 2 + node * node)
    t = np.array(terms)
    top = t.max(0)
    return float(-2 * (np.log(scale) - math.log(math.pi) / 2 + top + np.log(np.exp(t - top).sum(0))).sum())


@dataclass
class GlmerResult(Fitted):
    formula: Formula
    prep: Prepared
    rows: Rows
    family: Family
    layout: Layout
    theta: np.ndarray
    state: State
    value: float
    converged: bool
    points: int
    source: DataFrame = field(repr=False)
    options: dict = field(default_factory=dict, repr=False)

    def fixef(self) -> dict[str, float]:
        return dict(zip(self.prep.x_names, self.state.beta.tolist(), strict=True))

    def vcov(self) -> np.ndarray:
        return self.state.unscaled_vcov

    def npar(self) -> int:
        return self.prep.p + len(self.theta)

    def nobs(self) -> int:
        return self.rows.n

    def df_residual(self) -> int:
        return self.rows.n - self.prep.p

    def deviance(self) -> float:
        return self.value

    def log_lik(self) -> float:
        return -self.value / 2

    def aic(self) -> float:
        return self.value + 2 * self.npar()

    def bic(self) -> float:
        return self.value + math.log(self.rows.n) * self.npar()

    def covariances(self) -> list[np.ndarray]:
        return [f @ f.T for f in self.layout.factors(self.theta)]

    def effects(self, k: int = 0) -> np.ndarray:
        return self.state.u[k] @ self.layout.factors(self.theta)[k].T

    def ranef(self, k: int = 0) -> DataFrame:
        rows = [(key, *map(float, u)) for key, u in zip(self.rows.keys[k], self.effects(k), strict=True)]
        return self.source.sparkSession.createDataFrame(rows, ["level", *self.prep.z_names[k]])

    def augmented(self) -> DataFrame:
        """The prepared frame with ``eta``, ``mu``, ``residual``, ``pearson`` and ``deviance`` columns."""
        data, eta = self.prep.data, F.col("o")
        for i, b in enumerate(self.state.beta.tolist()):
            eta = eta + b * F.col(f"x{i}")
        for k in range(len(self.prep.random)):
            table = self.source.sparkSession.createDataFrame([(key, list(map(float, u))) for key, u in zip(self.rows.keys[k], self.effects(k), strict=True)], f"g{k} string, u{k} array<double>")
            data = data.join(F.broadcast(table) if len(self.rows.keys[k]) <= 200_000 else table.hint("merge"), f"g{k}")
            for i, z in enumerate(random_names(self.prep, k)):
                eta = eta + F.col(f"u{k}")[i] * F.col(z)
        data = data.withColumn("eta", eta)
        data = data.withColumn("mu", self.family.mean(F.col("eta"), SPARK)).withColumn("residual", F.col("y") - F.col("mu"))
        unit = self.family.deviance(F.col("y"), F.col("mu"), F.col("w"), SPARK)
        return data.withColumn("pearson", F.col("residual") * F.sqrt(F.col("w") / self.family.variance(F.col("mu"), SPARK))).withColumn("deviance", F.signum("residual") * F.sqrt(F.greatest(unit, F.lit(0.0))))

    def ngrps(self) -> dict[str, int]:
        return {r.group: len(k) for r, k in zip(self.prep.random, self.rows.keys, strict=True)}

    def components(self) -> dict[str, float]:
        s = self.state
        return {"total": self.value, "deviance": s.deviance, "ussq": s.penalty, "ldL2": s.log_det}

    def coef(self, k: int = 0) -> DataFrame:
        """Each level's coefficients: fixed and random together."""
        fixed = self.fixef()
        return self.ranef(k).select("level", *[(F.col(f"`{n}`") + fixed.get(n, 0.0)).alias(n) for n in self.prep.z_names[k]])

    def linear_predictor(self, new: DataFrame, random: bool = True, allow_new_levels: bool = False, offset: str | None = None) -> DataFrame:
        """``new`` with a column ``eta``. Unseen levels count 0 if allowed and are an error otherwise."""
        encode = Encoder(new, self.prep.contrasts, dict(self.prep.levels))
        total, data = F.col(f"`{offset}`").cast("double") if offset else F.lit(0.0), new
        for (_, c), b in zip(encode.terms(self.formula.fixed), self.state.beta.tolist(), strict=True):
            total = total + b * c
        for k, r in enumerate(self.prep.random if random else []):
            levels = self.source.sparkSession.createDataFrame([(key, list(map(float, u))) for key, u in zip(self.rows.keys[k], self.effects(k), strict=True)], f"__g{k} string, __u{k} array<double>")
            data = data.withColumn(f"__g{k}", group_key(r)).join(F.broadcast(levels) if len(self.rows.keys[k]) <= 200_000 else levels, f"__g{k}", "left")
            if not allow_new_levels and data.where(F.col(f"__u{k}").isNull()).limit(1).count():
                raise ValueError("new levels of a grouping factor; allow_new_levels=True gives them no effect")
            for i, (_, c) in enumerate(encode.terms(r.terms)):
                total = total + F.coalesce(F.col(f"__u{k}")[i], F.lit(0.0)) * c
        return data.withColumn("eta", total).drop(*[f"__{c}{k}" for c in "gu" for k in range(len(self.prep.random))])

    def predict(self, new: DataFrame, kind: str = "response", random: bool = True, allow_new_levels: bool = False, offset: str | None = None) -> DataFrame:
        """``new`` with a column ``fit``: the mean (response) or the linear predictor (link)."""
        if kind not in ("response", "link"):
            raise ValueError(f"unknown prediction {kind!r}")
        data = self.linear_predictor(new, random, allow_new_levels, offset)
        return data.withColumn("fit", self.family.mean(F.col("eta"), SPARK) if kind == "response" else F.col("eta")).drop("eta")

    def residuals(self, kind: str = "deviance") -> DataFrame:
        """augmented() with a column ``resid``: deviance, pearson, response or working."""
        data = self.augmented()
        found = {"deviance": F.col("deviance"), "pearson": F.col("pearson"), "response": F.col("residual"), "working": F.col("residual") * self.family.link.slope(F.col("mu"), SPARK)}
        if kind not in found:
            raise ValueError(f"unknown residuals {kind!r}; known: {', '.join(found)}")
        return data.withColumn("resid", found[kind])

    def working_levels(self) -> tuple[list, np.ndarray, np.ndarray] | tuple[None, None, None]:
        """Of a single term at the estimates: level keys, conditional covariances, and Z'WX under the working weights."""
        if len(self.prep.random) > 1:
            raise ValueError("leverages need a single random term")
        if not self.prep.random:
            return None, None, None
        rows, lam = self.rows, self.layout.factors(self.theta)[0]
        weight, k, p = rows.w * self.family.weight(self.state.mu), lam.shape[0], rows.x.shape[1]
        zx = np.stack([np.bincount(rows.level[0], weight * rows.z[0][:, i] * rows.x[:, j], len(rows.keys[0])) for i in range(k) for j in range(p)], 1).reshape(-1, k, p)
        return rows.keys[0], lam @ np.linalg.inv(self.state.precision[0]) @ lam.T, zx

    def leverages(self) -> DataFrame:
        """augmented() with ``hat`` and ``cooks``, of the working linear model at the estimates (a single term, or none)."""
        p = self.prep.p
        data = with_hat(self.augmented(), p, self.state.unscaled_vcov, F.col("w") * self.family.weight(F.col("mu"), SPARK), *self.working_levels())
        return data.withColumn("cooks", F.col("pearson") ** 2 * F.col("hat") / (p * (1 - F.col("hat")) ** 2)).drop("lean")

    def simulate(self, seed: int = 0, random: bool = True) -> DataFrame:
        """The prepared frame with ``sim``: a response drawn by the family, given new effects of every level or the fitted ones."""
        data, eta = self.augmented() if not random else self.prep.data, F.col("eta")
        if random:
            eta = F.col("o")
            for i, b in enumerate(self.state.beta.tolist()):
                eta = eta + b * F.col(f"x{i}")
            for k, f in enumerate(self.layout.factors(self.theta)):
                drawn = [_normal_of(F.col(f"g{k}"), seed, 100 * k + i) for i in range(f.shape[0])]
                for i, z in enumerate(random_names(self.prep, k)):
                    eta = eta + sum((float(f[i, j]) * drawn[j] for j in range(i + 1)), F.lit(0.0)) * F.col(z)
        family = self.family

        @F.pandas_udf("double")
        def drawn_of(mu: pd.Series, w: pd.Series, number: pd.Series) -> pd.Series:
            rng = np.random.default_rng([seed, int(number.iloc[0])]) if len(mu) else None
            if family.name == "binomial":  # a share of w trials
                trials = np.maximum(1, np.rint(w.to_numpy())).astype(int)
                return pd.Series(rng.binomial(trials, mu) / trials) if len(mu) else mu
            return pd.Series(family.simulate(mu.to_numpy(), rng)) if len(mu) else mu

        return data.withColumn("sim", drawn_of(family.mean(eta, SPARK), F.col("w"), F.monotonically_increasing_id()))

    def update(self, formula: str | None = None, data: DataFrame | None = None) -> GlmerResult:
        from lamina.plans.formula import update

        return glmer(update(self.formula, formula) if formula else self.formula, data if data is not None else self.source, **self.options)

    def refitted(self, formula: Formula, data: DataFrame, **changes) -> GlmerResult:
        """The model of another formula or data with the same settings."""
        return glmer(formula, data, **(self.options | changes))

    def refit(self, response: str, data: DataFrame | None = None) -> GlmerResult:
        """The same model for another response column."""
        return glmer(replace(self.formula, response=response), data if data is not None else self.source, **self.options)

    def refit_ml(self) -> GlmerResult:
        """Itself: these models are fitted by maximum likelihood."""
        return self

    def criterion(self, theta: np.ndarray) -> float:
        """The deviance at other covariance parameters, fixed effects at their best there."""
        state = pirls(np.asarray(theta, float), self.rows, self.family, self.layout, self.state)
        return state.laplace if self.points <= 1 else quadrature(np.asarray(theta, float), self.rows, self.family, self.layout, state, self.points)

    def glance(self) -> DataFrame:
        row = (type(self).__name__, self.family.name, self.nobs(), int(sum(self.ngrps().values())), len(self.prep.random), self.npar(), self.df_residual(), self.log_lik(), self.deviance(), self.aic(), self.bic(), self.converged, self.is_singular())
        return self.source.sparkSession.createDataFrame([row], "model string, family string, nobs long, n_groups long, n_grouping_factors int, npar int, df_residual long, log_lik double, deviance double, aic double, bic double, converged boolean, singular boolean")

    def summary(self) -> str:
        lines = [f"Generalised linear mixed model ({self.family.name}, {self.family.link.name} link)", f"Formula: {self.formula}", f"deviance {self.value:.4f}, {self.nobs()} observations, groups {self.ngrps()}"]
        lines += [f"  {v['group']}: " + ", ".join(f"{n} sd {s:.5g}" for n, s in zip(v["names"], v["sd"], strict=True)) for v in self.var_corr()]
        return "\n".join(lines + [f"  {n}: {b:.6g} (se {s:.4g}, z {b / s:.3f})" for (n, b), s in zip(self.fixef().items(), self.std_errors(), strict=True)])

    def tidy(self) -> DataFrame:
        rows = []
        for name, b, se in zip(self.prep.x_names, self.state.beta.tolist(), np.sqrt(np.diag(self.vcov())).tolist(), strict=True):
            rows.append(("fixed", name, b, se, b / se, 2 * tails.norm_sf(abs(b / se))))
        return self.source.sparkSession.createDataFrame(rows, "effect string, term string, estimate double, std_error double, statistic double, p_value double")


def glmer(formula: str | Formula, data: DataFrame, family: str | Family = "binomial", link: str | None = None, weights: str | None = None, offset: str | None = None, points: int = 1, na_action: str = "omit", contrasts: dict[str, str] | None = None, control: GeneralisedControl | None = None) -> GlmerResult:
    """Fit a GLMM: Laplace (points=1) or adaptive quadrature with so many points a level."""
    fam = family if isinstance(family, Family) else family_of(family, link)
    options = {"family": fam, "weights": weights, "offset": offset, "points": points, "na_action": na_action, "contrasts": contrasts, "control": control}
    prep = prepare(formula, data, weights, offset, na_action, contrasts, binomial=fam.name == "binomial")
    return fit_rows(prep.formula, prep, collapse(prep), fam, layout_of(prep), points, data, options)


def criterion_of(rows: Rows, fam: Family, layout: Layout, points: int = 1, control: GeneralisedControl | None = None):
    """The deviance as a function of theta; each evaluation starts from the last one's modes."""
    control = control or GeneralisedControl()
    last: list[State | None] = [None]

    def criterion(theta: np.ndarray) -> float:
        try:
            state = pirls(np.asarray(theta, float), rows, fam, layout, last[0], control.inner_iterations, control.tol_pwrss)
        except np.linalg.LinAlgError:
            return 1e10
        last[0] = state
        return state.laplace if points <= 1 else quadrature(theta, rows, fam, layout, state, points)

    return criterion, last


def fit_rows(formula: Formula, prep: Prepared, rows: Rows, fam: Family, layout: Layout, points: int, source: DataFrame, options: dict, start: np.ndarray | None = None) -> GlmerResult:
    """The model of collapsed rows."""
    control = options.get("control") or GeneralisedControl()
    criterion, last = criterion_of(rows, fam, layout, points, control)
    best = run(criterion, layout.start() if start is None else start, layout.bounds(), control.optimizer, **({"limit": 800} | control.settings())) if sum(layout.sizes) else None
    theta = best.x if best else np.zeros(0)
    return model_at(formula, prep, rows, fam, layout, theta, points, source, options, last[0], best.converged if best else True)


def model_at(formula: Formula, prep: Prepared, rows: Rows, fam: Family, layout: Layout, theta: np.ndarray, points: int, source: DataFrame, options: dict, state: State | None = None, converged: bool = True) -> GlmerResult:
    """The fitted object at given covariance parameters."""
    state = pirls(theta, rows, fam, layout, state)
    value = state.laplace if points <= 1 else quadrature(theta, rows, fam, layout, state, points)
    return GlmerResult(formula, prep, rows, fam, layout, theta, state, value, converged, points, source, options)


def glmer_nb(formula: str, data: DataFrame, low: float = 0.05, high: float = 500.0, **options) -> tuple[GlmerResult, float]:
    """A negative binomial model whose theta maximises the likelihood: golden section over its logarithm."""
    def fit(log_theta: float) -> GlmerResult:
        return glmer(formula, data, family_of("negative_binomial", theta=math.exp(log_theta)), **options)

    def value(log_theta: float) -> float:
        m, th = fit(log_theta), math.exp(log_theta)
        y, w = m.rows.y, m.rows.w
        constant = sum(wi * (math.lgamma(yi + th) - math.lgamma(th) - math.lgamma(yi + 1) + (yi * math.log(yi) if yi > 0 else 0.0) + th * math.log(th) - (yi + th) * math.log(yi + th)) for yi, wi in zip(y, w, strict=True))
        return m.value - 2 * constant

    at, _ = golden(value, math.log(low), math.log(high), 1e-4)
    return fit(at), math.exp(at)
