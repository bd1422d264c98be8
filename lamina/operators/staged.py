"""The stages of a fit, one by one: formula and data, criterion, optimum, model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.families import Family
from lamina.functions.families import family as family_of
from lamina.operators.glmm import GlmerResult, Rows, collapse, criterion_of, model_at
from lamina.operators.gram import Gram, gram
from lamina.operators.lmm import Layout, LmerResult, layout_of, solve
from lamina.operators.optimise import Minimum, minimise
from lamina.plans.formula import Formula
from lamina.plans.frame import Prepared, prepare


@dataclass
class Parsed:
    prep: Prepared
    gram: Gram
    layout: Layout
    reml: bool
    source: DataFrame = field(repr=False)
    options: dict = field(default_factory=dict)


def parse_data(formula: str | Formula, data: DataFrame, reml: bool = True, **options) -> Parsed:
    prep = prepare(formula, data, **options)
    return Parsed(prep, gram(prep), layout_of(prep), reml, data, options)


def criterion(parsed: Parsed) -> Callable[[np.ndarray], float]:
    def value(theta: np.ndarray) -> float:
        s = solve(np.asarray(theta, float), parsed.gram, parsed.layout, parsed.reml, False)
        return 1e10 if s is None else s.deviance

    return value


def optimise(fun: Callable[[np.ndarray], float], parsed: Parsed, start: np.ndarray | None = None) -> Minimum:
    return minimise(fun, parsed.layout.start() if start is None else start, parsed.layout.bounds())


def model(parsed: Parsed, best: Minimum) -> LmerResult:
    return LmerResult(parsed.prep.formula, parsed.prep, parsed.gram, parsed.layout, best.x, solve(best.x, parsed.gram, parsed.layout, parsed.reml), parsed.reml, best.converged, best.evaluations, parsed.source, parsed.options)


@dataclass
class ParsedGeneralised:
    prep: Prepared
    rows: Rows
    family: Family
    layout: Layout
    points: int
    source: DataFrame = field(repr=False)
    options: dict = field(default_factory=dict)


def parse_generalised(formula: str | Formula, data: DataFrame, family: str | Family = "binomial", link: str | None = None, points: int = 1, **options) -> ParsedGeneralised:
    """The first stage of a generalised model: the prepared frame and its collapsed rows."""
    fam = family if isinstance(family, Family) else family_of(family, link)
    prep = prepare(formula, data, binomial=fam.name == "binomial", **options)
    return ParsedGeneralised(prep, collapse(prep), fam, layout_of(prep), points, data, options | {"family": fam, "points": points})


def criterion_generalised(parsed: ParsedGeneralised) -> Callable[[np.ndarray], float]:
    return criterion_of(parsed.rows, parsed.family, parsed.layout, parsed.points)[0]


def model_generalised(parsed: ParsedGeneralised, best: Minimum) -> GlmerResult:
    return model_at(parsed.prep.formula, parsed.prep, parsed.rows, parsed.family, parsed.layout, best.x, parsed.points, parsed.source, parsed.options, None, best.converged)


def over_some(fun: Callable[[np.ndarray], float], theta: np.ndarray, which: list[int]) -> Callable[[np.ndarray], float]:
    """The criterion as a function of some parameters, the others held."""
    theta = np.asarray(theta, float)

    def value(part: np.ndarray) -> float:
        full = theta.copy()
        full[which] = part
        return fun(full)

    return value


def random_terms(parsed: Parsed | ParsedGeneralised) -> list[dict]:
    """The random terms: group, names of the effects, number of levels, structure, and where their parameters begin."""
    keys = parsed.gram.keys if isinstance(parsed, Parsed) else parsed.rows.keys
    begins = np.cumsum([0, *parsed.layout.sizes]).tolist()
    return [{"group": r.group, "names": z, "levels": len(k), "structure": kind, "begin": b, "size": n} for r, z, k, kind, b, n in zip(parsed.prep.random, parsed.prep.z_names, keys, parsed.layout.kinds, begins, parsed.layout.sizes, strict=True)]


def new_random_design(parsed: Parsed | ParsedGeneralised, new: DataFrame, k: int = 0) -> DataFrame:
    """Rows of ``new`` as (level, design) of a term; rows of levels that the model doesn't know are left out."""
    from lamina.plans.frame import Encoder, group_key

    r = parsed.prep.random[k]
    keys = parsed.gram.keys[k] if isinstance(parsed, Parsed) else parsed.rows.keys[k]
    encode = Encoder(new, parsed.prep.contrasts, dict(parsed.prep.levels))
    known = new.sparkSession.createDataFrame([(x,) for x in keys], "level string")
    rows = new.select("*", group_key(r).alias("level"), *[c.alias(f"z_{n}") for n, c in encode.terms(r.terms)])
    return rows.join(F.broadcast(known) if len(keys) <= 200_000 else known, "level", "left_semi")
