"""Self-starting nonlinear curves as columns: value, gradient and moment starting values; and their mixed model fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.families import NUMPY, SPARK


@dataclass(frozen=True)
class Curve:
    """``value(ops, x, *parameters)`` over columns or arrays; ``begin`` gives parameters of max, min, median and range."""

    name: str
    parameters: tuple[str, ...]
    value: Callable
    begin: Callable[[dict[str, float]], list[float]]

    def column(self, x: Column, parameters: list[float]) -> Column:
        return self.value(SPARK, x, *[F.lit(float(p)) for p in parameters])

    def array(self, x: np.ndarray, parameters: list[float]) -> np.ndarray:
        return self.value(NUMPY, x, *parameters)

    def gradient(self, x: np.ndarray, parameters: list[float]) -> np.ndarray:
        """Central differences, scaled to each parameter."""
        out = []
        for i, p in enumerate(parameters):
            h = 1e-6 * max(1.0, abs(p))
            up, down = list(parameters), list(parameters)
            up[i], down[i] = p + h, p - h
            out.append((self.array(x, up) - self.array(x, down)) / (2 * h))
        return np.stack(out, 1)

    def start(self, df: DataFrame, x: str, y: str) -> list[float]:
        """Starting values from one aggregation; the median is exact."""
        r = df.agg(F.max(y).alias("max_y"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.min(x).alias("min_x"), F.percentile(x, 0.5).alias("median_x")).first()
        return self.begin({k: float(r[k]) for k in r.asDict()})


def _expit(ops, t):
    return 1 / (1 + ops.exp(-t))


CURVES = {
    c.name: c
    for c in (
        Curve("asymptotic", ("asym", "r0", "lrc"), lambda o, x, a, r, c: a + (r - a) * o.exp(-o.exp(c) * x), lambda s: [s["max_y"], s["min_y"], float(np.log(1 / max(s["max_x"], 1e-10)))]),
        Curve("logistic", ("asym", "xmid", "scal"), lambda o, x, a, m, s: a * _expit(o, (x - m) / s), lambda s: [s["max_y"], s["median_x"], (s["max_x"] - s["min_x"]) / 4]),
        Curve("michaelis", ("vm", "k"), lambda o, x, v, k: v * x / (k + x), lambda s: [1.1 * s["max_y"], s["median_x"]]),
        Curve("four_parameter", ("a", "b", "xmid", "scal"), lambda o, x, a, b, m, s: a + (b - a) * _expit(o, (x - m) / s), lambda s: [s["min_y"], s["max_y"], s["median_x"], (s["max_x"] - s["min_x"]) / 4]),
        Curve("gompertz", ("asym", "b2", "b3"), lambda o, x, a, b, c: a * o.exp(-b * o.exp(o.log(c) * x)), lambda s: [s["max_y"], 1.0, 0.5]),
        Curve("biexponential", ("a1", "lrc1", "a2", "lrc2"), lambda o, x, a, l1, b, l2: a * o.exp(-o.exp(l1) * x) + b * o.exp(-o.exp(l2) * x), lambda s: [s["max_y"] / 2, float(np.log(0.1)), s["max_y"] / 2, float(np.log(0.01))]),
    )
}
