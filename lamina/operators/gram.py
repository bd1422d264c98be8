"""Weighted cross-products: the one aggregation over rows that linear mixed models need.

``gram`` groups by a random term's level and sums products of columns, with map-side partial sums, the totals among them;
each further term and each pair of terms is one more aggregation. Everything after it works on levels, not rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.plans.frame import Prepared

#: Levels of a random term that are read to the driver; a single term beyond this is evaluated on the cluster.
MAX_LEVELS = 1_000_000
#: Random effects that crossed terms may have beside the largest term, as what its elimination leaves is one dense matrix.
MAX_CROSSED = 6000


@dataclass
class Gram:
    n: int
    log_w: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    keys: list[list[str]] = field(default_factory=list)  # levels of each term
    zz: list[np.ndarray] = field(default_factory=list)  # levels x k x k
    zx: list[np.ndarray] = field(default_factory=list)  # levels x k x p
    zy: list[np.ndarray] = field(default_factory=list)  # levels x k
    cross: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def largest(self) -> int:
        """The term with the most effects."""
        return max(range(len(self.zz)), key=lambda t: self.zz[t].shape[0] * self.zz[t].shape[1])


def _products(left: list[str], right: list[str], weight: str = "w") -> list[Column]:
    return [F.sum(F.col(weight) * F.col(a) * F.col(b)) for a in left for b in right]


def fixed_names(prep: Prepared) -> list[str]:
    return [f"x{i}" for i in range(prep.p)]


def random_names(prep: Prepared, k: int) -> list[str]:
    return [f"z{k}_{i}" for i in range(len(prep.z_names[k]))]


def _total_columns(prep: Prepared) -> list[Column]:
    x = fixed_names(prep)
    return [F.count("*").alias("n"), F.sum(F.log("w")).alias("log_w"), F.array(*_products(x, x)).alias("xx"), F.array(*_products(x, ["y"])).alias("xy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy")]


def level_table(prep: Prepared, k: int, whole: bool = False) -> DataFrame:
    """One row a level: key, n, and arrays of sums zz, zx, zy (row by row); with ``whole`` also log_w, xx, xy and yy."""
    x, z = fixed_names(prep), random_names(prep, k)
    first = _total_columns(prep) if whole else [F.count("*").alias("n")]
    return prep.data.withColumn("y", F.col("y") - F.col("o")).groupBy(F.col(f"g{k}").alias("key")).agg(
        *first, F.array(*_products(z, z)).alias("zz"), F.array(*_products(z, x)).alias("zx"), F.array(*_products(z, ["y"])).alias("zy"))


def totals(prep: Prepared) -> tuple[int, float, np.ndarray, np.ndarray, float]:
    p = prep.p
    row = prep.data.withColumn("y", F.col("y") - F.col("o")).agg(*_total_columns(prep)).first()
    if not row["n"]:
        raise ValueError("no complete rows")
    return row["n"], float(row["log_w"]), np.array(row["xx"]).reshape(p, p), np.array(row["xy"]), float(row["yy"])


def gram(prep: Prepared) -> Gram:
    """All cross-products of a prepared frame, with the levels in sorted order. The first term's level sums add up to the
    totals, so a model with one term reads its rows once."""
    out = None if prep.random else Gram(*totals(prep))
    for k in range(len(prep.random)):
        width, table = len(prep.z_names[k]), level_table(prep, k, out is None)
        rows = table.limit(MAX_LEVELS + 1).toPandas().sort_values("key")
        if len(rows) > MAX_LEVELS:
            raise ValueError(f"{prep.random[k].group} has more than {MAX_LEVELS} levels; use operators.large.lmer_large")
        if out is None:
            if not len(rows):
                raise ValueError("no complete rows")
            sums = {c: np.array(rows[c].to_list()).sum(0) for c in ("n", "log_w", "xx", "xy", "yy")}
            out = Gram(int(sums["n"]), float(sums["log_w"]), sums["xx"].reshape(prep.p, prep.p), sums["xy"], float(sums["yy"]))
        out.keys.append(rows["key"].tolist())
        out.zz.append(np.array(rows["zz"].to_list()).reshape(-1, width, width))
        out.zx.append(np.array(rows["zx"].to_list()).reshape(-1, width, prep.p))
        out.zy.append(np.array(rows["zy"].to_list()).reshape(-1, width))
    if len(out.keys) > 1:
        if sum(z.shape[0] * z.shape[1] for t, z in enumerate(out.zz) if t != out.largest()) > MAX_CROSSED:
            raise ValueError(f"crossed terms with more than {MAX_CROSSED} effects beside the largest term need a sparse solver")
        places = [{key: i for i, key in enumerate(keys)} for keys in out.keys]
        for a in range(len(out.keys)):
            for b in range(a + 1, len(out.keys)):
                rows = prep.data.groupBy(F.col(f"g{a}").alias("ka"), F.col(f"g{b}").alias("kb")).agg(F.array(*_products(random_names(prep, a), random_names(prep, b))).alias("s")).toPandas()
                out.cross[a, b] = (rows["ka"].map(places[a]).to_numpy(), rows["kb"].map(places[b]).to_numpy(), np.array(rows["s"].to_list()).reshape(len(rows), out.zz[a].shape[1], out.zz[b].shape[1]))
    return out
