"""Model diagnostics as aggregations over augmented rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import tails
from lamina.functions.families import SPARK, Family
from lamina.operators.gram import Gram


def correlations(g: Gram, names: list[str]) -> tuple[list[str], np.ndarray]:
    """Weighted centred correlations of the fixed columns, from the Gram matrix alone; needs an intercept."""
    i = names.index("(Intercept)")
    keep = [j for j in range(len(names)) if j != i]
    total = g.xx[i, i]
    mean = g.xx[i, keep] / total
    cov = g.xx[np.ix_(keep, keep)] / total - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    return [names[j] for j in keep], cov / np.outer(sd, sd)


def vif(g: Gram, names: list[str]) -> dict[str, float]:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    kept, corr = correlations(g, names)
    return dict(zip(kept, np.diag(np.linalg.inv(corr)).tolist(), strict=True))


def condition_indices(g: Gram, names: list[str]) -> np.ndarray:
    values = np.linalg.eigvalsh(correlations(g, names)[1])[::-1]
    return np.sqrt(values[0] / values)


def dispersion(rows: DataFrame, fam: Family, df: int) -> dict[str, float]:
    """Pearson chi-square of a table with y, mu and w over the residual degrees of freedom, with its upper tail."""
    chi = float(rows.agg(F.sum(F.col("w") * (F.col("y") - F.col("mu")) ** 2 / fam.variance(F.col("mu"), SPARK)).alias("c")).first()["c"])
    return {"chisq": chi, "df": df, "ratio": chi / df, "p_value": tails.chi2_sf(chi, df)}


def zero_inflation(rows: DataFrame, fam: Family) -> dict[str, float]:
    """Zeros seen and expected (Poisson, negative binomial, binomial), and the normal tail of their difference."""
    mu = F.col("mu")
    none = {"poisson": F.exp(-mu), "binomial": F.pow(1 - mu, F.col("w"))}.get(fam.name, F.pow(fam.theta / (fam.theta + mu), F.lit(fam.theta)))
    r = rows.agg(F.count_if(F.col("y") == 0).alias("seen"), F.sum(none).alias("expected"), F.sum(none * (1 - none)).alias("variance")).first()
    z = (r["seen"] - r["expected"] - 0.5) / math.sqrt(r["variance"])
    return {"seen": r["seen"], "expected": r["expected"], "ratio": r["seen"] / r["expected"], "z": z, "p_value": tails.norm_sf(z)}


def variance_parts(model) -> dict[str, float]:
    """Variances of the fixed predictor, of all random effects (averaged over rows), and of the residual."""
    rows = model.augmented()
    fixed = float(rows.agg(F.var_pop("fixed").alias("v")).first()["v"])
    random = 0.0
    for k, cov in enumerate(model.covariances()):
        z = [F.col(f"z{k}_{i}") for i in range(len(cov))]
        quad = sum((float(cov[i, j]) * z[i] * z[j] for i in range(len(cov)) for j in range(len(cov))), F.lit(0.0))
        random += float(rows.agg(F.avg(quad).alias("v")).first()["v"])
    return {"fixed": fixed, "random": random, "residual": model.solved.sigma2}


def r2_nakagawa(model) -> dict[str, float]:
    v = variance_parts(model)
    total = sum(v.values())
    return {"marginal": v["fixed"] / total, "conditional": (v["fixed"] + v["random"]) / total}


def icc(model) -> dict[str, float]:
    v = variance_parts(model)
    return {"adjusted": v["random"] / (v["random"] + v["residual"]), "unadjusted": v["random"] / sum(v.values())}


def influential(rows: DataFrame, n: int, p: int) -> DataFrame:
    """Rows of leverages() with threshold flags: Cook's distance over 4 / n, leverage over 2 p / n."""
    return rows.withColumns({"high_cooks": F.col("cooks") > 4.0 / n, "high_hat": F.col("hat") > 2.0 * p / n})
