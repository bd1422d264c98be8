"""Checks of a design before it is fitted, from cross-products and level counts only."""

from __future__ import annotations

import math
import warnings

import numpy as np

from lamina.operators.gram import Gram
from lamina.plans.frame import Prepared


def problems(prep: Prepared, g: Gram) -> list[str]:
    """What is doubtful about the design, as text; an empty list if nothing is."""
    out = []
    rank = int(np.linalg.matrix_rank(g.xx / np.sqrt(np.outer(np.diag(g.xx), np.diag(g.xx)))))
    if rank < prep.p:
        out.append(f"the fixed part has rank {rank}, not {prep.p}")
    spread = np.sqrt(np.diag(g.xx) / g.n)
    if len(spread) > 1 and math.log10(spread.max() / spread.min()) > 3:
        out.append("the fixed columns are on very different scales")
    for r, keys, names in zip(prep.random, g.keys, prep.z_names, strict=True):
        levels, effects = len(keys), len(keys) * len(names)
        if levels <= 1:
            out.append(f"{r.group} has one level")
        elif levels < 5:
            out.append(f"{r.group} has fewer than 5 levels")
        if g.n < 2 * levels:
            out.append(f"{r.group} has fewer than 2 rows a level on average")
        if effects >= g.n:
            out.append(f"{r} has as many effects as there are rows")
    return out


def run(prep: Prepared, g: Gram, action: str = "warn") -> list[str]:
    """ignore, warn or stop."""
    found = problems(prep, g) if action != "ignore" else []
    for text in found:
        if action == "stop":
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    return found
