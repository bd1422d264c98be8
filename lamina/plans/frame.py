"""The prepared frame: a formula over a DataFrame as named columns, without materialised design matrices.

Columns of the prepared frame: ``y``, ``w`` (prior weights), ``o`` (offset), ``x0..`` (fixed design), ``g0..`` (level key
of each random term, as text) and ``z0_0..`` (its design). Rows with a missing model variable are filtered in the scan;
only the variables of the formula are read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.plans.formula import Factor, Formula, RandomTerm, Term, parse, show, split_double_bars

#: Distinct levels of a factor in the fixed part that are read to the driver; more are an error, not a truncation.
MAX_FIXED_LEVELS = 1000


def missing(df: DataFrame, name: str) -> Column:
    """Null, or not a number."""
    c = F.col(f"`{name}`")
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return (c.isNull() | F.isnan(c)) if floating else c.isNull()


def complete(df: DataFrame, names: list[str], action: str = "omit") -> DataFrame:
    """Rows without a missing value in the named columns; ``fail`` raises instead, naming the columns."""
    kind = action.replace("na.", "").replace("na_", "").lower()
    if kind not in ("omit", "exclude", "fail"):
        raise ValueError(f"unknown NA action {action!r}")
    if kind == "fail":
        counts = df.agg(*[F.count_if(missing(df, n)).alias(n) for n in names]).first()
        if bad := [n for n in names if counts[n]]:
            raise ValueError(f"missing values in {', '.join(bad)}")
        return df
    gap = F.lit(False)
    for n in names:
        gap = gap | missing(df, n)
    return df.where(~gap)


def is_factor(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType) or "levels" in (df.schema[name].metadata or {})


def levels_of(df: DataFrame, name: str) -> list[str]:
    """Declared levels, or the sorted distinct values, of a factor in the fixed part."""
    declared = (df.schema[name].metadata or {}).get("levels")
    if declared:
        return list(declared)
    found = [r[0] for r in df.select(f"`{name}`").where(F.col(f"`{name}`").isNotNull()).distinct().limit(MAX_FIXED_LEVELS + 1).collect()]
    if len(found) > MAX_FIXED_LEVELS:
        raise ValueError(f"{name} has more than {MAX_FIXED_LEVELS} levels; use it as a grouping factor")
    return sorted(found)


def level_codes(df: DataFrame, name: str) -> DataFrame:
    """(level, code) with dense codes from 0 in sorted order: ranks within first characters, plus what comes before them."""
    levels = df.select(F.col(f"`{name}`").cast("string").alias("level")).where(F.col("level").isNotNull()).distinct()
    # the partition is a function of the level, so counts and ranks agree whenever either is computed again
    buckets = levels.withColumn("bucket", F.substring("level", 1, 1))
    sizes = sorted((r["bucket"], r["n"]) for r in buckets.groupBy("bucket").agg(F.count("*").alias("n")).collect())
    before = dict(zip([b for b, _ in sizes], itertools.accumulate([0, *[n for _, n in sizes]]), strict=False))
    table = df.sparkSession.createDataFrame([(b, n) for b, n in before.items()] or [("", 0)], "bucket string, base long")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("level")) - 1
    return buckets.withColumn("at", rank).join(F.broadcast(table), "bucket").select("level", (F.col("base") + F.col("at")).alias("code"))


def contrast_matrix(kind, n: int, base: int = 0) -> list[list[float]]:
    """treatment, sum (or deviation), helmert (columns of unit length) or poly contrasts of n levels, or a matrix of one's
    own: a row for each level. ``base`` is the reference level of treatment contrasts. One level is a column of ones."""
    import numpy as np

    if not isinstance(kind, str):
        own = np.asarray(kind, float)
        if own.ndim != 2 or own.shape[0] != n:
            raise ValueError(f"a contrast matrix for {n} levels needs {n} rows")
        return own.tolist()
    if n < 2:
        return [[1.0]] * n
    if kind == "treatment":
        return np.delete(np.eye(n), base, 1).tolist()
    if kind in ("sum", "deviation"):
        return np.vstack([np.eye(n - 1), -np.ones(n - 1)]).tolist()
    if kind == "helmert":
        level, column = np.arange(n)[:, None], np.arange(n - 1)[None, :]
        raw = np.where(level <= column, -1.0, np.where(level == column + 1, column + 1.0, 0.0))
        return (raw / np.linalg.norm(raw, axis=0)).tolist()
    if kind == "poly":
        scores = np.arange(n) - (n - 1) / 2
        q, r = np.linalg.qr(np.vander(scores, n, increasing=True))
        return (q * np.sign(np.diag(r)))[:, 1:].tolist()
    raise ValueError(f"unknown contrasts {kind!r}")


def dummy(df: DataFrame, name: str, base: int | str | None = None, contrasts: str = "treatment") -> DataFrame:
    """The rows with the coding columns of one factor, named by level (treatment) or number; ``base`` None keeps all levels'
    indicators."""
    known = levels_of(df, name)
    c = F.col(f"`{name}`")
    if base is None and contrasts == "treatment":
        return df.select("*", *[(c == v).cast("double").alias(f"{name}.{v}") for v in known])
    at = known.index(base) if isinstance(base, str) else int(base or 0)
    matrix = contrast_matrix(contrasts, len(known), at)
    labels = [v for i, v in enumerate(known) if i != at] if contrasts == "treatment" else range(1, len(matrix[0]) + 1)
    return df.select("*", *[coded(c, known, [row[j] for row in matrix]).alias(f"{name}.{label}") for j, label in enumerate(labels)])


def coded(c: Column, known: list[str], values: list[float]) -> Column:
    """The value of each known level; null for others."""
    out = F.lit(None).cast("double")
    for level, value in zip(known, values, strict=True):
        out = F.when(c == level, F.lit(float(value))).otherwise(out)
    return out


def factorize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns with their sorted levels declared in the column's metadata."""
    names = columns or [n for n, t in df.dtypes if t == "string"]
    return _declared(df, names)


def _declared(df: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.col(f"`{n}`").cast("string"))
        df = df.withMetadata(n, {"levels": levels_of(df, n)})
    return df


def expand_to_original(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """All rows of ``df`` with ``column`` of the rows that were fitted (``values``, by a unique ``key``), null where a row was
    left out for a missing value: what the action "exclude" promises."""
    return df.join(values.select(key, column), key, "left")


@dataclass
class Prepared:
    formula: Formula
    data: DataFrame
    x_names: list[str]
    random: list[RandomTerm]
    z_names: list[list[str]]
    levels: dict[str, list[str]] = field(default_factory=dict)
    contrasts: dict[str, str] = field(default_factory=dict)
    columns: list[Column] = field(default_factory=list)  # the x columns, over the original names
    assign: list[str] = field(default_factory=list)  # the term of each x column

    @property
    def p(self) -> int:
        return len(self.x_names)


class Encoder:
    """Terms as columns. Levels and contrasts are those of the data that the model was fitted to."""

    def __init__(self, df: DataFrame, contrasts: dict[str, str] | None = None, levels: dict[str, list[str]] | None = None) -> None:
        self.df, self.contrasts, self.levels = df, contrasts or {}, levels if levels is not None else {}

    def factor(self, f: Factor, full: bool) -> list[tuple[str, Column]]:
        c = F.col(f"`{f.name}`")
        if f.name not in self.levels and not is_factor(self.df, f.name):
            value = c.cast("double")
            for _ in range(f.power - 1):
                value = value * c.cast("double")
            return [(str(f), value if f.power else F.lit(1.0))]
        known = self.levels.setdefault(f.name, levels_of(self.df, f.name) if f.name not in self.levels else [])
        if full:
            return [(f"{f.name}.{v}", (c == v).cast("double")) for v in known]
        if len(known) == 1:
            return [(f.name, F.lit(1.0))]
        matrix = contrast_matrix(self.contrasts.get(f.name, "treatment"), len(known))
        return [(f"{f.name}.{j + 1}", coded(c, known, [row[j] for row in matrix])) for j in range(len(matrix[0]))]

    def terms(self, terms: tuple[Term, ...]) -> list[tuple[str, Column]]:
        out: list[tuple[str, Column]] = []
        self.assign: list[str] = []
        full = () not in terms
        for term in terms:
            if not term:
                out.append(("(Intercept)", F.lit(1.0)))
                self.assign.append("(Intercept)")
                continue
            alone = len(term) == 1 and full and (term[0].name in self.levels or is_factor(self.df, term[0].name))
            parts = [self.factor(f, alone) for f in term]
            full = full and not alone  # only the first factor of a model without intercept has all its levels
            made = [("", None)]
            for part in parts:
                made = [(f"{a}:{b}" if a else b, y if x is None else x * y) for a, x in made for b, y in part]
            out += made
            self.assign += [show(term)] * len(made)
        if not out:
            self.assign.append("(Intercept)")
        return out or [("(Intercept)", F.lit(1.0))]


def group_key(r: RandomTerm) -> Column:
    """The level key as text; nested factors are joined by a slash."""
    return F.concat_ws("/", *[F.col(f"`{g}`").cast("string") for g in r.grouping])


def prepare(formula: str | Formula, df: DataFrame, weights: str | None = None, offset: str | None = None, na_action: str = "omit", contrasts: dict[str, str] | None = None, binomial: bool = False) -> Prepared:
    """The model frame as a lazy DataFrame; small factor levels are the only thing read here."""
    f = split_double_bars(parse(formula))
    names = f.variables
    if unknown := [n for n in names if n not in df.columns]:
        raise ValueError(f"not in the data: {', '.join(unknown)}")
    extra = [c for c in (weights, offset) if c]
    kept = complete(df.select(*[f"`{n}`" for n in dict.fromkeys([*names, *extra])]), list(dict.fromkeys([*names, *extra])), na_action)
    if weights and (bad := kept.where(~(F.col(f"`{weights}`") > 0) | (F.col(f"`{weights}`") == float("inf"))).limit(1).count()):
        raise ValueError(f"weights must be finite and positive: {bad} row or more is not")
    encode = Encoder(kept, contrasts)
    x = encode.terms(f.fixed)
    assign = encode.assign
    y, w = F.col(f"`{f.response}`").cast("double"), F.col(f"`{weights}`").cast("double") if weights else F.lit(1.0)
    if f.trials:
        trials = F.col(f"`{f.trials}`").cast("double")
        if binomial:
            if kept.where((trials <= 0) | (y < 0) | (y > trials) | (y != F.floor(y)) | (trials != F.floor(trials))).limit(1).count():
                raise ValueError("grouped responses need whole successes between 0 and positive whole trials")
            w = w * trials
        y = y / trials
    z = [encode.terms(r.terms) for r in f.random]
    columns = [y.alias("y"), w.alias("w"), (F.col(f"`{offset}`").cast("double") if offset else F.lit(0.0)).alias("o")]
    columns += [c.alias(f"x{i}") for i, (_, c) in enumerate(x)]
    for k, (r, zs) in enumerate(zip(f.random, z, strict=True)):
        columns += [group_key(r).alias(f"g{k}"), *[c.alias(f"z{k}_{i}") for i, (_, c) in enumerate(zs)]]
    return Prepared(f, kept.select(*columns), [n for n, _ in x], list(f.random), [[n for n, _ in zs] for zs in z], encode.levels, contrasts or {}, [c for _, c in x], assign)


def describe(terms: tuple[Term, ...]) -> str:
    return " + ".join(map(show, terms))
