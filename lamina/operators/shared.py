"""What fitted linear and generalised mixed models have in common: accessors over the prepared frame and the parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.plans.formula import show

BROADCAST_LEVELS = 200_000


def quadratic(x: list[Column], a: np.ndarray) -> Column:
    """x' a x for columns x and a small symmetric matrix."""
    total = F.lit(0.0)
    for i, xi in enumerate(x):
        for j, xj in enumerate(x):
            total = total + xi * float(a[i, j]) * xj
    return total


def with_levels(data: DataFrame, key: str, keys: list, columns: dict[str, np.ndarray]) -> DataFrame:
    """Join arrays of numbers a level by the text key; levels of a checked number are broadcast, more are shuffled."""
    import pandas as pd

    table = pd.DataFrame({key: keys} | {n: v.reshape(len(keys), -1).tolist() for n, v in columns.items()})
    levels = data.sparkSession.createDataFrame(table, ", ".join([f"{key} string", *[f"{n} array<double>" for n in columns]]))
    return data.join(F.broadcast(levels) if len(keys) <= BROADCAST_LEVELS else levels.hint("merge"), key)


def with_hat(data: DataFrame, p: int, unscaled: np.ndarray, weight: Column, keys: list | None, c: np.ndarray | None, zx: np.ndarray | None) -> DataFrame:
    """``data`` (x0.., and z0_0.. with g0 if there are levels) with ``hat``, and ``lean``: each row's x less what its level's
    effects answer for it. ``c`` is a level's conditional covariance without the residual variance, ``zx`` its cross-products."""
    x, hat = [F.col(f"x{i}") for i in range(p)], F.lit(0.0)
    if keys is not None:
        k = c.shape[1]
        data = with_levels(data, "g0", keys, {"__c": c, "__m": np.einsum("gij,gjp->gip", c, zx)})
        z = [F.col(f"z0_{i}") for i in range(k)]
        x = [F.col(f"x{j}") - sum((z[i] * F.col("__m")[i * p + j] for i in range(k)), F.lit(0.0)) for j in range(p)]
        for i in range(k):
            for j in range(k):
                hat = hat + weight * z[i] * F.col("__c")[i * k + j] * z[j]
    data = data.withColumn("hat", F.least(hat + weight * quadratic(x, unscaled), F.lit(1 - 1e-10))).withColumn("lean", F.array(*x))
    return data.drop("__c", "__m")


class Fitted:
    """Accessors. Tables of rows or levels are DataFrames; parameters are small arrays."""

    @property
    def spark(self):
        return self.source.sparkSession

    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov()))

    def extract_aic(self) -> tuple[int, float]:
        return self.npar(), self.aic()

    def re_pca(self) -> list[dict]:
        """Standard deviations of the principal components of each term's relative covariance, with their shares."""
        out = []
        for r, f in zip(self.prep.random, self.layout.factors(self.theta), strict=True):
            values = np.clip(np.linalg.eigvalsh(f @ f.T)[::-1], 0, None)
            share = values / values.sum() if values.sum() > 0 else np.zeros_like(values)
            out.append({"group": r.group, "sdev": np.sqrt(values), "proportion": share, "cumulative": np.cumsum(share)})
        return out

    def is_singular(self, tol: float = 1e-4) -> bool:
        return any(np.linalg.eigvalsh(f @ f.T).min() < tol * tol for f in self.layout.factors(self.theta))

    def at_boundary(self, tol: float = 1e-6) -> bool:
        """Whether a parameter lies on a bound."""
        return any(t - low <= tol or high - t <= tol for t, (low, high) in zip(self.theta, self.layout.bounds(), strict=True))

    def var_corr(self) -> list[dict]:
        """One entry a term: group, names, variance, sd, cov, corr."""
        out = []
        for r, names, cov in zip(self.prep.random, self.prep.z_names, self.covariances(), strict=True):
            sd = np.sqrt(np.diag(cov))
            out.append({"group": r.group, "names": names, "variance": np.diag(cov), "sd": sd, "cov": cov, "corr": cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1)})
        return out

    def var_corr_table(self) -> DataFrame:
        """group, term1, term2 (null on the diagonal), covariance, sdcor (a standard deviation or a correlation)."""
        rows = []
        for v in self.var_corr():
            for i, a in enumerate(v["names"]):
                rows.append((v["group"], a, None, float(v["cov"][i, i]), float(v["sd"][i])))
                rows += [(v["group"], a, b, float(v["cov"][i, j]), float(v["corr"][i, j])) for j, b in enumerate(v["names"]) if j > i]
        if hasattr(self, "solved"):
            rows.append(("Residual", None, None, float(self.solved.sigma2), self.sigma))
        return self.spark.createDataFrame(rows, "group string, term1 string, term2 string, covariance double, sdcor double")

    def terms(self) -> dict[str, list[str]]:
        """The terms as written: response, fixed, random, and the columns that each fixed term became."""
        f = self.formula
        return {"response": [f.response], "fixed": [show(t) if t else "1" for t in f.fixed], "random": [str(r) for r in f.random], "assign": list(self.prep.assign), "columns": list(self.prep.x_names)}

    def model_frame(self) -> DataFrame:
        """The rows that were fitted: response, weight, offset, designs and level keys."""
        return self.prep.data

    def model_matrix(self) -> DataFrame:
        """The fixed design with its column names."""
        return self.prep.data.select(*[F.col(f"x{i}").alias(n) for i, n in enumerate(self.prep.x_names)])

    def random_matrix(self, k: int = 0) -> DataFrame:
        """The random design of a term as (level, its columns): the nonzero part of each row."""
        return self.prep.data.select(F.col(f"g{k}").alias("level"), *[F.col(f"z{k}_{i}").alias(n) for i, n in enumerate(self.prep.z_names[k])])

    def weights(self) -> DataFrame:
        return self.prep.data.select("w")

    def offset(self) -> DataFrame:
        return self.prep.data.select("o")

    def get_me(self, name: str):
        """A component by its short name: X, Z, y, theta, beta, Lambda, u, b, sigma, n, p, q, lower, flist, cnms, devcomp."""
        simple = {"theta": lambda: self.theta, "beta": lambda: np.array(list(self.fixef().values())), "X": self.model_matrix, "Z": self.random_matrix, "y": lambda: self.prep.data.select("y"), "Lambda": lambda: self.layout.factors(self.theta), "n": self.nobs, "p": lambda: self.prep.p, "lower": lambda: np.array([b[0] for b in self.layout.bounds()]), "flist": lambda: [r.group for r in self.prep.random], "cnms": lambda: self.prep.z_names, "sigma": lambda: getattr(self, "sigma", 1.0), "q": lambda: sum(n * len(z) for n, z in zip(self.ngrps().values(), self.prep.z_names, strict=True)), "b": lambda: [self.ranef(k) for k in range(len(self.prep.random))], "devcomp": lambda: self.components()}
        if name not in simple:
            raise ValueError(f"unknown component {name!r}; known: {', '.join(simple)}")
        return simple[name]()

    def confint(self, level: float = 0.95) -> dict[str, tuple[float, float]]:
        """Wald intervals of the fixed effects."""
        z = tails.norm_ppf(0.5 + level / 2)
        return {n: (b - z * s, b + z * s) for (n, b), s in zip(self.fixef().items(), self.std_errors().tolist(), strict=True)}

    def tidy_all(self, level: float = 0.95) -> DataFrame:
        """One row an estimate: effect (fixed, ran_pars or ran_vals), group, level, term, estimate, std_error, statistic,
        conf_low, conf_high; what does not apply is null. Levels stay on the cluster."""
        schema = "effect string, group string, level string, term string, estimate double, std_error double, statistic double, conf_low double, conf_high double"
        rows = [("fixed", None, None, n, b, s, b / s, *ci) for (n, b), s, ci in zip(self.fixef().items(), self.std_errors().tolist(), self.confint(level).values(), strict=True)]
        for v in self.var_corr():
            for i, a in enumerate(v["names"]):
                rows.append(("ran_pars", v["group"], None, f"sd__{a}", float(v["sd"][i]), None, None, None, None))
                rows += [("ran_pars", v["group"], None, f"cor__{a}.{b}", float(v["corr"][i, j]), None, None, None, None) for j, b in enumerate(v["names"]) if j > i]
        if hasattr(self, "solved"):
            rows.append(("ran_pars", "Residual", None, "sd__Observation", self.sigma, None, None, None, None))
        out, z = self.spark.createDataFrame(rows, schema), tails.norm_ppf(0.5 + level / 2)
        for k, r in enumerate(self.prep.random):
            table = self.ranef(k)
            for n in self.prep.z_names[k]:
                se = F.sqrt(F.col(f"`condvar_{n}`")) if f"condvar_{n}" in table.columns else F.lit(None).cast("double")
                b = F.col(f"`{n}`").cast("double")
                out = out.unionByName(table.select(F.lit("ran_vals").alias("effect"), F.lit(r.group).alias("group"), F.col("level").cast("string").alias("level"), F.lit(n).alias("term"), b.alias("estimate"), se.alias("std_error"), F.lit(None).cast("double").alias("statistic"), (b - z * se).alias("conf_low"), (b + z * se).alias("conf_high")))
        return out
